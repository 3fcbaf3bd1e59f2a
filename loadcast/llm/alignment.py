"""Links between the tokens that two tokenizers cut the same texts into.

Each tokenizer's tokens are rows of a token-byte incidence matrix in compressed sparse rows (``Csr``). A row product
A . B-transposed (Gustavson: the rows of B-transposed that a row of A names, added up) gives the overlap links: which
tokens share how many bytes. Ordered by token, these links walk down both token lists; where a step leaves both its tokens,
both lists end at the same byte, and a new group begins. The products of group-incidence matrices, token ids by
groups, give the shared-group links with their number of occurrences, without listing equal pairs of a group one by one.

Texts are linked in windows that are cut where both lists end, so the byte matrices stay small however long a text is.
No token of either vocabulary goes on past a word end, so where single spaces part a text's words, each distinct word
goes through the libraries once and is then looked up; ``WORDS_KEPT`` bounds the memory of the lookup, never the result.

Counts over all documents: texts are put in blocks. A block lists its distinct id pairs once, with how many of its
documents hold them, and keeps a sparse matrix of documents by pairs. The counts are added up over blocks and joined back
to the blocks' distinct pairs (not to the documents'), and every block multiplies its matrix with them.

Defined cases: a null or empty text, and one whose tokens do not spell a space and the text, has no tokens: zeros and an
empty string. Repeated rows are documents each and count as such. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import UNSAFE, load_library, slices

BLOCK_BYTES = 6_000_000
SLICE_BYTES = 200_000
WINDOW_BYTES = 250_000
WORDS_KEPT = 300_000
FACTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = ("part int, block int, doc_ids array<long>, " + ", ".join(f"{f} array<long>" for f in FACTS)
         + ", groups_sha256 array<string>, sizes binary, steps binary, repeats binary, pairs array<long>, held array<int>")
RESULT = ("doc_id long, " + ", ".join(f"{f} long" for f in FACTS) + ", n_best long, count_sum long, "
          "groups_sha256 string")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix: row r has ``values[k]`` at ``columns[k]`` for k from ``starts[r]`` to ``starts[r + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> "Csr":
        """From entries in any order; entries of the same place are added."""
        keys = rows * shape[1] + columns
        steps = np.diff(keys, prepend=-1)
        if (steps < 0).any():
            order = np.argsort(keys, kind="stable")
            keys, rows, columns, values = keys[order], rows[order], columns[order], values[order]
            steps = np.diff(keys, prepend=-1)
        if not steps.all():
            first = np.flatnonzero(steps)
            rows, columns, values = rows[first], columns[first], np.add.reduceat(values, first)
        starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=shape[0]))])
        return Csr(starts, columns, values, shape[1])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> "Csr":
        return Csr.of(self.columns, self.rows(), self.values, (self.width, len(self.starts) - 1))

    def product(self, other: "Csr") -> "Csr":
        """Row by row: the rows of ``other`` that a row names, times its values, added up."""
        lengths = np.diff(other.starts)[self.columns]
        ends = np.cumsum(lengths)
        places = np.repeat(other.starts[self.columns] - (ends - lengths), lengths) + np.arange(lengths.sum())
        return Csr.of(np.repeat(self.rows(), lengths), other.columns[places],
                      np.repeat(self.values, lengths) * other.values[places], (len(self.starts) - 1, other.width))

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The product with a column of whole numbers."""
        total = np.concatenate([[0], np.cumsum(self.values * vector[self.columns])])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def token_bytes(ends: np.ndarray, first: int, stop: int) -> Csr:
    """Incidence of the tokens that end at ``ends`` with the bytes ``first`` to ``stop``."""
    size = stop - first
    starts = np.concatenate([[0], ends - first])
    return Csr(starts, np.arange(size), np.ones(size, np.int64), size)


def bytes_tokens(ends: np.ndarray, first: int, stop: int) -> Csr:
    """The same transposed: a byte's row names its one token."""
    size = stop - first
    lengths = np.diff(ends, prepend=first)
    return Csr(np.arange(size + 1), np.repeat(np.arange(len(ends)), lengths), np.ones(size, np.int64), len(ends))


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray, first: int, stop: int) -> Csr:
    """A-tokens by B-tokens: the number of bytes that they share."""
    return token_bytes(a_ends, first, stop).product(bytes_tokens(b_ends, first, stop))


def groups(links: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A-token and of each B-token, numbered from 0."""
    rows, columns = links.rows(), links.columns
    group = np.cumsum((np.diff(rows, prepend=rows[:1]) != 0) & (np.diff(columns, prepend=columns[:1]) != 0))
    of_b = np.zeros(links.width, np.int64)
    of_b[columns] = group
    return group[links.starts[:-1]], of_b


def letters_of_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Spellings:
    """The bytes of every id."""

    def __init__(self, of_id: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in of_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(of_id), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after the other, and where each ends."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(lengths.sum())], ends


#: Every number below 2**17 in decimal, with a comma behind it.
DECIMALS = Spellings([f"{k},".encode() for k in range(1 << 17)])


@dataclass
class Ragged:
    """Lists of ids one after the other: list k ends before ``ends[k + 1]``."""

    values: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(lists: list[list[int]]) -> "Ragged":
        ends = np.cumsum([0, *map(len, lists)])
        return Ragged(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1])), ends)

    def and_then(self, other: "Ragged") -> "Ragged":
        return Ragged(np.concatenate([self.values, other.values]),
                      np.concatenate([self.ends, self.ends[-1] + other.ends[1:]]))

    def take(self, lists: np.ndarray) -> "Ragged":
        lengths = np.diff(self.ends)[lists]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return Ragged(self.values[np.repeat(self.ends[lists] - ends[:-1], lengths) + np.arange(ends[-1])], ends)


class Tokenizers:
    """Both libraries, with the bytes of their ids."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a = load_library(byte_vocabulary)
        self.a.encode_special_tokens = True
        letters = letters_of_bytes()
        spelled = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab(with_added_tokens=False).items():
            spelled[number] = bytes(map(letters.__getitem__, token))
        self.a_bytes = Spellings(spelled)
        self.slots: dict[str, int] = {}
        self.words = [Ragged.of([]), Ragged.of([])]
        self.b = SentencePieceProcessor(model_file=piece_vocabulary)
        pieces = range(self.b.get_piece_size())
        self.b_bytes = Spellings([bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k)
                                  else self.b.id_to_piece(k).replace("▁", " ").encode() for k in pieces])

    def sizes(self) -> tuple[int, int]:
        return len(self.a_bytes.lengths), len(self.b_bytes.lengths)

    def libraries(self, texts: list[str]) -> tuple[Ragged, Ragged]:
        """The ids of a space and each text, from the libraries themselves."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return Ragged.of([e.ids for e in a]), Ragged.of(self.b.encode(texts, num_threads=1))

    def ids(self, texts: list[str]) -> list[Ragged]:
        """The same, word by word where single spaces part the words."""
        texts = pa.array(texts, pa.string())
        whole = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        words = pc.list_flatten(split).dictionary_encode()
        spelled = words.dictionary.to_numpy(zero_copy_only=False)
        if len(self.slots) > WORDS_KEPT:
            self.slots, self.words = {}, [Ragged.of([]), Ragged.of([])]
        known = self.slots.get
        slots = np.fromiter((known(w, -1) for w in spelled), np.int64, len(spelled))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            new = spelled[unknown].tolist()
            slots[unknown] = len(self.slots) + np.arange(len(new))
            self.slots.update(zip(new, slots[unknown].tolist()))
            self.words = [w.and_then(n) for w, n in zip(self.words, self.libraries(new))]
        at = slots[words.indices.to_numpy(zero_copy_only=False)]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
        found = [Ragged(some.values, some.ends[ends]) for some in (w.take(at) for w in self.words)]
        if whole.any():
            alone = self.libraries(texts.filter(pa.array(whole)).to_pylist())
            order = np.where(whole, (~whole).sum() + np.cumsum(whole) - 1, np.cumsum(~whole) - 1)
            found = [f.and_then(o).take(order) for f, o in zip(found, alone)]
        return found


@dataclass
class Linked:
    """Texts: facts by name, hash of the groups, and links as (text, pair) counts, ordered by text and pair."""

    facts: np.ndarray
    hashes: list[str]
    sizes: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray


def link_texts(tokenizers: Tokenizers, texts: list[str]) -> Linked:
    """Tokens, groups and shared-group links of texts; a pair is ``a * size of B's vocabulary + b``."""
    raw = [(" " + t).encode() for t in texts]
    of_a, of_b = tokenizers.ids(texts)
    valid = np.array([bool(t) for t in texts], bool)
    for side, spellings in ((of_a, tokenizers.a_bytes), (of_b, tokenizers.b_bytes)):
        valid &= spells(spellings, side, raw)
    kept = np.flatnonzero(valid)
    if len(kept) < len(texts):
        of_a, of_b = of_a.take(kept), of_b.take(kept)
    a, a_bounds, b, b_bounds = of_a.values.astype(np.int64), of_a.ends, of_b.values.astype(np.int64), of_b.ends
    a_group, b_group = group_numbers(np.cumsum(tokenizers.a_bytes.lengths[a]), np.cumsum(tokenizers.b_bytes.lengths[b]))
    n_groups = int(a_group[-1]) + 1 if len(a) else 0
    bounds = np.append(a_group[a_bounds[:-1]], n_groups)
    text_of, a_size, b_size = np.repeat(np.arange(len(kept)), np.diff(a_bounds)), *tokenizers.sizes()
    # (text, A-id) by group, times group by B-id
    row_keys, rows = ranked(text_of * a_size + a)
    links = (Csr.of(rows, a_group, np.ones(len(a), np.int64), (len(row_keys), n_groups))
             .product(Csr.of(b_group, b, np.ones(len(b), np.int64), (n_groups, b_size))))
    keys = row_keys[links.rows()]
    sizes = np.zeros(len(texts), np.int64)
    sizes[kept] = np.bincount(keys // a_size, minlength=len(kept))
    facts = np.zeros((len(FACTS), len(texts)), np.int64)
    facts[:3, kept] = np.diff(a_bounds), np.diff(b_bounds), np.diff(bounds)
    total = np.concatenate([[0], np.cumsum(links.values)])[np.concatenate([[0], np.cumsum(sizes)])]
    facts[3] = np.diff(total)
    hashes = [""] * len(texts)
    for k, text in zip(kept.tolist(), group_texts(a, b, a_group, b_group, a_bounds + b_bounds)):
        hashes[k] = hashlib.sha256(text).hexdigest()
    return Linked(facts, hashes, sizes, keys % a_size * b_size + links.columns, links.values)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.diff(ordered, prepend=-1) != 0
    places = np.empty(len(keys), np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[new], places


def spells(spellings: Spellings, lists: Ragged, raw: list[bytes]) -> np.ndarray:
    """Which lists of ids spell their bytes."""
    spelled, token_ends = spellings.joined(lists.values)
    ends = np.concatenate([[0], token_ends])[lists.ends]
    if np.array_equal(np.diff(ends), [len(r) for r in raw]) and spelled.tobytes() == b"".join(raw):
        return np.ones(len(raw), bool)
    spelled = spelled.tobytes()
    return np.array([spelled[ends[k]:ends[k + 1]] == r for k, r in enumerate(raw)], bool)


def group_numbers(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token, from overlap products of windows that end where both lists do."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    cuts = common[np.flatnonzero(np.diff(common // WINDOW_BYTES, append=-1))]
    a_group, b_group = np.zeros(len(a_ends), np.int64), np.zeros(len(b_ends), np.int64)
    first = before = 0
    for stop in cuts.tolist():
        in_a, in_b = (slice(*np.searchsorted(e, [first, stop], side="right")) for e in (a_ends, b_ends))
        own_a, own_b = groups(overlaps(a_ends[in_a], b_ends[in_b], first, stop))
        a_group[in_a], b_group[in_b] = own_a + before, own_b + before
        first, before = stop, before + int(own_a[-1]) + 1
    return a_group, b_group


def group_texts(a, b, a_group, b_group, bounds):
    """``a1,a2|b1;a3|b2`` of each text: the ids of a group, A's before B's, each with the sign that follows it."""
    places = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    ids = np.concatenate([a, b])[places]
    group = np.concatenate([a_group, b_group])[places]
    of_b = places >= len(a)
    lengths = DECIMALS.lengths[ids]
    written, ends = DECIMALS.joined(ids)
    written = written.copy()
    last = ends - 1
    written[last[:-1][~of_b[:-1] & of_b[1:]]] = ord("|")
    written[last[:-1][group[:-1] != group[1:]]] = ord(";")
    data, at = written.tobytes(), np.concatenate([[0], np.cumsum(lengths)])[bounds].tolist()
    return [data[s:e - 1] for s, e in zip(at, at[1:])]


@lru_cache(maxsize=1)
def tokenizer_pair(byte_vocabulary: str, piece_vocabulary: str) -> Tokenizers:
    """One pair in a Python worker."""
    return Tokenizers(byte_vocabulary, piece_vocabulary)


def packed(values: np.ndarray) -> pa.Array:
    """One compressed cell of 32-bit numbers."""
    data = values.astype("<i4").tobytes()
    return pa.array([len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)], pa.binary())


def unpacked(cell: bytes) -> np.ndarray:
    data = pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), "zstd", asbytes=True)
    return np.frombuffer(data, "<i4").astype(np.int64)


def block_row(doc_ids: list, parts: list[Linked], part: int, block: int) -> pa.RecordBatch:
    """The facts of a block's texts, its distinct pairs, and its matrix of texts by pairs, in steps from pair to pair."""
    pairs, which = ranked(np.concatenate([p.pairs for p in parts]))
    held = np.bincount(which, minlength=len(pairs))
    ints, facts = pa.list_(pa.int64()), np.concatenate([p.facts for p in parts], axis=1)
    stored = [np.concatenate([p.sizes for p in parts]), np.diff(which, prepend=0), np.concatenate([p.counts for p in parts])]
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([doc_ids], ints),
        *(pa.array([f], ints) for f in facts), pa.array([[h for p in parts for h in p.hashes]], pa.list_(pa.string())),
        *map(packed, stored), pa.array([pairs], ints), pa.array([held.astype(np.int32)], pa.list_(pa.int32()))],
        names=[c.split()[0] for c in BLOCK.split(", ")])


def linked_blocks(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """Texts in blocks of about ``BLOCK_BYTES``; see ``BLOCK``."""
    def link(batches):
        part, block = TaskContext.get().partitionId(), 0
        tokenizers = tokenizer_pair(byte_vocabulary, piece_vocabulary)
        doc_ids, parts, size = [], [], 0
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(some.column("text"), "")
                parts.append(link_texts(tokenizers, texts.to_numpy(zero_copy_only=False).tolist()))
                doc_ids += some.column("doc_id").to_pylist()
                size += pc.sum(pc.binary_length(texts)).as_py() + some.num_rows
                if size >= BLOCK_BYTES:
                    yield block_row(doc_ids, parts, part, block)
                    block, doc_ids, parts, size = block + 1, [], [], 0
        if parts:
            yield block_row(doc_ids, parts, part, block)

    return docs.select("doc_id", "text").mapInArrow(link, BLOCK)


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold an id pair, and whether no pair of its A-id is held by more."""
    counts = (blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.held").cast("long")).alias("n")))
    of_a = Window.partitionBy(F.expr(f"pair div {width}"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def with_sums(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per document, from each block's matrices and the counts of its distinct pairs."""
    asked = blocks.select("part", "block", F.posexplode("pairs").alias("at", "pair"))
    answers = (asked.join(counts, "pair").groupBy("part", "block")
               .agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("found")))
    answers = answers.select("part", "block", F.col("found.n").alias("n"), F.col("found.best").alias("best"))

    def sums(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes, steps, counts = (unpacked(row[c].as_py()) for c in ("sizes", "steps", "repeats"))
                n, best = (np.asarray(row[c].as_py() or [], np.int64) for c in ("n", "best"))
                links = Csr(np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(steps), counts, len(n))
                yield pa.RecordBatch.from_arrays([
                    row["doc_ids"].values, *(row[f].values for f in FACTS), pa.array(links.times(best), pa.int64()),
                    pa.array(links.times(n), pa.int64()), row["groups_sha256"].values],
                    names=[c.split()[0] for c in RESULT.split(", ")])

    return blocks.drop("pairs", "held").join(answers, ["part", "block"], "left").mapInArrow(sums, RESULT)


def align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """doc_id, tokens of both, groups, links, links that are their A-id's most frequent, counts over links, groups' hash."""
    from sentencepiece import SentencePieceProcessor

    blocks = stage(linked_blocks(docs, byte_vocabulary, piece_vocabulary), "alignment-blocks")
    width = SentencePieceProcessor(model_file=piece_vocabulary).get_piece_size()
    counts = stage(pair_counts(blocks, width), "alignment-pairs")
    return with_sums(blocks, counts)


def pair_table(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """(a, b, n, best): the alignment of the two vocabularies as the corpus shows it."""
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=piece_vocabulary).get_piece_size()
    blocks = linked_blocks(docs, byte_vocabulary, piece_vocabulary).select("pairs", "held")
    return pair_counts(blocks, width).select(F.expr(f"pair div {width}").alias("a"), F.expr(f"pair % {width}").alias("b"),
                                             "n", "best")
