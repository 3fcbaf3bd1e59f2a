"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The pieces of all documents are packed by best-fit decreasing: longest first, each into the open
sequence with the least room that still holds it. Pieces of one length are interchangeable, so the
packing is decided on the number of pieces of each length, at most ``capacity`` numbers whatever the
size of the corpus: ``fit_plan`` descends a segment tree over the remaining capacities once for a whole
run of equal pieces. Each piece then finds its own place in the plan by its rank among the pieces of
its length. The result is the packing of the whole corpus, not of single partitions.

Defined cases: a null or empty text is one piece that holds only the end id; repeated rows are packed
each on their own; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import CHUNKS_KEPT, SLICE_BYTES, slices, tokenizer

CAPACITY = 2048
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, "
          "rank_in_part long")


class RoomTree:
    """A segment tree that counts the open sequences by their remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, number: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += number
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open sequence that is not below ``length``."""
        node = length + self.size
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node *= 2
            if not self.count[node]:
                node += 1
        return node - self.size


def fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Rows are (length, first rank, pieces, first sequence, pieces per sequence, first offset): the
    piece of rank ``first rank + i`` goes to sequence ``first sequence + i // per`` at
    ``first offset + (i % per) * length``. The number of rows depends on ``capacity`` only.
    """
    tree, runs, opened, rows = RoomTree(capacity), {}, 0, []

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            runs.setdefault(room, []).append((first, number))
            tree.add(room, number)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                need = -(-left // (capacity // length))
                put(capacity, opened, need)
                opened += need
                continue
            first, number = runs[room].pop()
            tree.add(room, -number)
            per = min(room // length, left)
            filled = min(number, left // per)
            rows.append((length, rank, filled * per, first, per, capacity - room))
            put(room - per * length, first, filled)
            put(room, first + filled, number - filled)
            rank += filled * per
            left -= filled * per
    return np.asarray(rows, np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0,
                 capacity: int = CAPACITY, with_ids: bool = True, chunks_kept: int = CHUNKS_KEPT,
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The pieces of every text, numbered within their length in each partition; ``ids`` may be left null.

    ``chunks_kept`` and ``slice_bytes`` bound a worker's memory, never the result.
    """

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        library = tokenizer(tokenizer_path, chunks_kept)
        for batch in (s for b in batches for s in slices(b, "text", slice_bytes)):
            flat, counts = library.encode(batch.column("text"))
            stop, rows = 0, []
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                ids = np.append(flat[stop:stop + n], np.uint32(end_id)).astype("<u4").tobytes()
                stop += n
                for piece, start in enumerate(range(0, n + 1, capacity)):
                    own = ids[4 * start:4 * (start + capacity)]
                    length = len(own) // 4
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), own if with_ids else None, part,
                                 seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
        pa.default_memory_pool().release_unused()

    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of a written table of pieces its ``sequence_id`` and ``offset``.

    ``pieces`` needs ``length``, ``part`` and ``rank_in_part`` (from 0 within part and length). The
    driver holds one count for each length and the plan, both bounded by ``capacity``.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select("part", "length", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = fit_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = (plan[:, 0] << 48) + plan[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        row = plan[np.searchsorted(keys, (length.to_numpy() << 48) + rank.to_numpy(), "right") - 1]
        own = rank.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + own // row[:, 4],
                             "offset": row[:, 5] + own % row[:, 4] * row[:, 0]})

    others = [c for c in pieces.columns if c not in ("part", "rank_in_part")]
    return (pieces.join(before, ["part", "length"])
            .withColumn("at", place("length", F.col("before") + F.col("rank_in_part")))
            .select(*others, "at.sequence_id", "at.offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and the ids of its pieces in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0,
                   capacity: int = CAPACITY, with_ids: bool = True, chunks_kept: int = CHUNKS_KEPT,
                   slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all documents with their ids and places."""
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, with_ids, chunks_kept, slice_bytes)
    packed = pack(stage(pieces, "pieces"), capacity)
    return packed if with_ids else packed.drop("ids")
