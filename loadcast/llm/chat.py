"""Chat formatting with a grammar round trip.

A turn is written as ``### role``, a line end, the text, and ``</turn>`` on a line of its own. ``parse`` is a
deterministic parser of that grammar. Every turn is rendered as it is and parsed again; if the parser does not give back
the same role and text, one more conflicting control string is escaped (a backslash before each of its places), until it
does. Escaping is reversible, because the parser takes one backslash away from before a control string, and a text's
own backslashes there conflict, so they are escaped as well.

``write_chats`` deals rows by ranges of (conversation, turn), so a conversation of any length is spread over tasks, and
writes pieces of whole turns in order, with the loss mask as code-point spans of the assistant's texts.
``read_chats`` parses the files alone. A conversation that lies in one piece is read where it lies; pieces of the others
are dealt by conversation and hashed as a stream, since a SHA-256 has to be computed in order.

Defined cases: a null text or role is empty; rows of the same turn are ordered by role, then text, and repeated rows are
turns each; a null turn comes first; rows without a conversation id form one conversation; a turn is never cut, however
long; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, STOP = "### ", "</turn>"
CONTROLS = (STOP, HEAD)
ROLE = "role"
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
ROLE_ESCAPE = re.compile(r"\\([\\n])")
PIECE_CHARS = 100_000
BATCH_CHARS = 2_000_000
FILE = ("conv_id long, part int, piece int, whole boolean, formatted string, "
        "loss array<struct<start: int, stop: int>>")
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Unreadable(ValueError):
    """A text that the grammar does not derive."""


def escaped(text: str, guarded) -> str:
    for control in CONTROLS:
        if control in guarded:
            text = text.replace(control, "\\" + control)
    return text


def unescaped(text: str) -> str:
    for control in CONTROLS:
        text = text.replace("\\" + control, control)
    return text


def head_of(role: str, guarded) -> str:
    if ROLE in guarded:
        role = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{HEAD}{role}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; a control string after a backslash is text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        if line < 0 or not formatted.startswith(HEAD, at):
            raise Unreadable(f"no turn begins at {at}")
        role = ROLE_ESCAPE.sub(lambda m: "\n" if m[1] == "n" else "\\", formatted[at + len(HEAD):line])
        bare = (m for m in CONTROL.finditer(formatted, line + 1) if formatted[m.start() - 1] != "\\")
        end = next(bare, None)
        if end is None or end[0] != STOP:
            raise Unreadable(f"the turn at {at} does not end")
        if end.start() < line + 2 or formatted[end.start() - 1] != "\n" or formatted[end.end():end.end() + 1] != "\n":
            raise Unreadable(f"the end at {end.start()} is not a line of its own")
        turns.append((role, unescaped(formatted[line + 1:end.start() - 1])))
        at = end.end() + 1
    return turns


def formatted_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and end of a turn that parses to exactly this role and text."""
    guarded: list[str] = []
    while True:
        turn = head_of(role, guarded), escaped(text, guarded), f"\n{STOP}\n"
        try:
            if parse("".join(turn)) == [(role, text)]:
                return turn
        except Unreadable:
            pass
        guarded.append(next(c for c in (*CONTROLS, ROLE) if c not in guarded and (c == ROLE or c in text)))


class Piece:
    """Turns of one conversation, one after the other, and their loss mask."""

    def __init__(self, conv_id, number: int) -> None:
        self.conv_id, self.number, self.length = conv_id, number, 0
        self.parts: list[str] = []
        self.loss: list[dict[str, int]] = []

    def add(self, role: str, text: str, learnt: str) -> None:
        head, body, end = formatted_turn(role, text)
        begin = self.length + len(head)
        if role == learnt:
            self.loss.append({"start": begin, "stop": begin + len(body)})
        self.parts += (head, body, end)
        self.length = begin + len(body) + len(end)


def piece_batch(rows: list[tuple[Piece, bool]], part: int) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return pa.RecordBatch.from_arrays([
        pa.array([p.conv_id for p, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()),
        pa.array([p.number for p, _ in rows], pa.int32()), pa.array([whole for _, whole in rows], pa.bool_()),
        pa.array(["".join(p.parts) for p, _ in rows], pa.string()), pa.array([p.loss for p, _ in rows], span)],
        names=["conv_id", "part", "piece", "whole", "formatted", "loss"])


def formatted_chats(turns: DataFrame, learnt: str = "assistant", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of conversations in order of (``part``, ``piece``); ``whole`` if no other piece has turns of it."""

    def render(batches):
        part, first, piece, done, size = TaskContext.get().partitionId(), True, None, [], 0

        def pieces():
            """Every piece, and whether it holds all of its conversation."""
            nonlocal first, piece
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
                for conv_id, role, text in zip(*columns):
                    if piece is not None and piece.conv_id != conv_id:
                        yield piece, piece.number == 0 and not first
                        first, piece = False, Piece(conv_id, 0)
                    elif piece is None:
                        piece = Piece(conv_id, 0)
                    elif piece.length >= piece_chars:
                        yield piece, False
                        piece = Piece(conv_id, piece.number + 1)
                    piece.add(role, text, learnt)
            if piece is not None:
                yield piece, False

        for one in pieces():
            done.append(one)
            size += one[0].length
            if size > BATCH_CHARS:
                yield piece_batch(done, part)
                done, size = [], 0
        if done:
            yield piece_batch(done, part)

    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    begin = F.substring("text", 1, 64)
    return (rows.repartitionByRange("conv_id", "turn", "role", begin)
            .sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(render, FILE))


def write_chats(turns: DataFrame, path: str, learnt: str = "assistant", piece_chars: int = PIECE_CHARS) -> None:
    formatted_chats(turns, learnt, piece_chars).write.parquet(path)


class Digest:
    """What is read back of one conversation."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, loss) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescaped(formatted[span["start"]:span["stop"]])
            self.loss_chars += len(text)
            self.learnt.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.chars)


def digests(batches):
    """Rows of adjacent pieces of the same conversation; only one conversation is open at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    open_one = None
    for batch in batches:
        rows = []
        for conv_id, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if open_one is None or open_one.conv_id != conv_id:
                if open_one is not None:
                    rows.append(open_one.row())
                open_one = Digest(conv_id)
            open_one.read(formatted, loss)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                         schema=schema)
    if open_one is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(open_one.row(), schema)], schema=schema)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """One row per written conversation, from the files alone."""
    pieces = spark.read.schema(FILE).parquet(path)
    columns = ["conv_id", "formatted", "loss"]
    alone = pieces.where("whole").select(*columns)
    spread = (pieces.where("not whole").select("part", "piece", *columns).repartition("conv_id")
              .sortWithinPartitions("conv_id", "part", "piece").select(*columns))
    return alone.mapInArrow(digests, DIGEST).unionByName(spread.mapInArrow(digests, DIGEST))
