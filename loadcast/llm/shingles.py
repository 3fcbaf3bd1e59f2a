"""Near copies by word shingles: SimHash fingerprints and pigeonhole blocks, exact Hamming distance, exact Jaccard similarity.

Two texts are linked if the sets of their word shingles have a Jaccard similarity of at least ``similarity``. Texts of the
same words have the same key, so exact copies are folded first. Every distinct text has several independently seeded
64-bit SimHash fingerprints of its shingles, as op 3 has one: a bit is set where over half of the hashes have it.

* The fingerprints are cut into blocks, and texts that agree on a block meet. At the similarity asked for, a bit differs
  with the chance that ``flip_chance`` gives (0.15 at 0.8), so ``layout`` takes as many blocks as let a pair miss all of
  them once in 100,000. A block is as wide as keeps about ``GROUP`` texts together by chance; more texts, wider blocks.
* Texts that meet are compared by the exact Hamming distance of their first 256 bits, whose limit lies five standard
  deviations above what ``similarity`` gives. What is within it, directly or by others, is a family.
* The texts of a family are compared on their whole shingle sets, by an index of their shingles, so nothing below
  ``similarity`` is linked. Links that keep components are kept, never the pairs of a group. A family of up to ``PART``
  texts is compared in one task, and its texts travel once. A larger one is cut into parts, and every two parts meet in a
  task of their own: no task grows with a family, but its texts travel once for each other part.

Defined cases: words are split at ASCII white space and A-Z are lowered; texts without words (null, empty, white space)
are copies of each other; fewer words than a shingle are one shingle; of a component the row with the smallest ``doc_id``
is kept, nulls last; an empty table gives an empty one; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components
from .common import spare, stage

SEED = 42
#: 64-bit fingerprints that are compared exactly.
CHECKED = 4
#: Texts that share a block by chance, about; chance that a pair shares none; standard deviations of the limits.
GROUP, MISSED, SPREAD = 2048, 1e-5, 5
#: Texts of a family that are compared in one task, about (twice as many of a larger family).
PART = 500
_CELLS = 1 << 16


def flip_chance(similarity: float) -> float:
    """Chance that a bit differs between sets of this Jaccard similarity; the angle is widest for equal sizes."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(rows: int, similarity: float) -> tuple[int, int, int]:
    """Blocks, bits of a block, and 64-bit fingerprints that hold them."""
    width = max(6, math.ceil(math.log2(max(rows, 1) / GROUP)))
    blocks = math.ceil(math.log(MISSED) / math.log1p(-min((1 - flip_chance(similarity)) ** width, 1 - MISSED)))
    return blocks, width, max(CHECKED, -(-blocks * width // 64))


def distance_limit(bits: int, similarity: float) -> int:
    """The Hamming distance of ``bits`` bits up to which texts are candidates."""
    p = flip_chance(similarity)
    return int(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def shingle_hashes(text: bytes, words_in_shingle: int = 5) -> tuple[int, np.ndarray]:
    """A key of the words, and the sorted distinct hashes of their shingles."""
    import xxhash

    words = text.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    k = min(words_in_shingle, len(words))
    if not words:
        return digest(joined, SEED), np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = (ends - sizes)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    return digest(joined, SEED), np.unique(hashes)


def fingerprints(hashes: np.ndarray, number: int) -> np.ndarray:
    """``number`` SimHash fingerprints of a set, each by hashes of a seed of its own."""
    total = np.zeros(64 * number, np.int64)
    seeds = np.arange(number, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for begin in range(0, len(hashes), 255):
        mixed = hashes[begin:begin + 255, None] + seeds
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def block_keys(prints: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """A key for each block of each row of fingerprints: the block's number and its bits."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, :blocks * width]
    values = bits.reshape(len(prints), blocks, width) @ (1 << np.arange(width, dtype=np.int64))
    return values + (np.arange(blocks, dtype=np.int64) << width)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member's place) after joining the components of ``a`` and ``b``."""
    while (label[a] != label[b]).any():
        label = label.copy()
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    return label


def families(prints: np.ndarray, similarity: float) -> np.ndarray:
    """Labels of the components of all rows within the limit of each other; memory is bounded by the rows."""
    label, (first, second) = np.arange(len(prints)), prints[:, :2].T.copy()
    soon, limit = distance_limit(128, similarity), distance_limit(64 * prints.shape[1], similarity)
    step = max(1, _CELLS // len(prints))
    for begin in range(0, len(prints), step):
        bits = np.bitwise_count(first[begin:begin + step, None] ^ first[begin:])
        bits += np.bitwise_count(second[begin:begin + step, None] ^ second[begin:])
        i, j = np.nonzero(bits <= soon)
        i, j = i + begin, j + begin
        apart = (i < j) & (label[i] != label[j])
        i, j = i[apart], j[apart]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= limit
        label = _merged(label, i[near], j[near])
    return label


def linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links with the components of all pairs of ``sets`` that are similar enough."""
    n, sizes = len(sets), np.array(list(map(len, sets)))
    if n == 2 and sizes.min() < similarity * sizes.max() - 1e-9:
        return []
    _, grams = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(grams, kind="stable")
    held = np.bincount(grams)
    stops = np.cumsum(held)
    owner_by_gram, own = owner[order], np.split(grams, np.cumsum(sizes)[:-1])
    label, found = np.arange(n), []
    # the texts with the commonest shingles first; pairs inside the largest component need no look
    waiting = np.argsort(-np.bincount(owner, held[grams], n) / np.maximum(sizes, 1), kind="stable")
    for i in waiting:
        counts = np.bincount(label, minlength=n)
        if counts.max() == n:
            break
        if counts[label[i]] > 1 and label[i] == counts.argmax():
            continue
        shared = np.bincount(np.concatenate([owner_by_gram[stops[g] - held[g]:stops[g]] for g in own[i]] or
                                            [np.zeros(0, np.int64)]), minlength=n)
        near = shared >= similarity * (sizes[i] + sizes - shared) - 1e-9
        for j in np.flatnonzero(near & (label != label[i])):
            if label[j] != label[i]:
                found.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return found


def _with_fingerprints(docs: DataFrame, node: str, prints: str, number: int, words_in_shingle: int) -> DataFrame:
    place = docs.columns.index("text")

    def compute(batches):
        for batch in batches:
            nodes, found = [], []
            for text in batch.column(place).cast(pa.binary()):
                own, hashes = shingle_hashes(text.as_py() or b"", words_in_shingle)
                nodes.append(own)
                found.append(fingerprints(hashes, number).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(found, pa.binary())],
                names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.LongType()),
                           T.StructField(prints, T.BinaryType())])
    names = schema.names
    return docs.mapInArrow(compute, schema)


def _groups(batches, columns: int):
    """The groups of rows sorted by their first column, as lists of arrays of the other columns."""
    key, held = None, []
    for batch in batches:
        keys, *others = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns))
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(bounds, bounds[1:]):
            if begin == end:
                continue
            if held and keys[begin] != key:
                yield [np.concatenate(parts) for parts in zip(*held)]
                held = []
            key = keys[begin]
            held.append([column[begin:end] for column in others])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def _stars(nodes: np.ndarray, label: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A link from every node to the first of its component."""
    own = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=names)


def candidates(distinct: DataFrame, similarity: float, blocks: int, width: int) -> DataFrame:
    """Edges ``a, b`` that keep the families of ``distinct`` (``node, prints``; written)."""

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            keys = block_keys(prints, blocks, width).ravel()
            nodes, *checked = (np.repeat(column, blocks) for column in (
                batch.column(0).to_numpy(), *prints.view(np.int64)[:, :CHECKED].T))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, nodes, *checked)], names=names)

    def link(batches):
        for nodes, *checked in _groups(batches, CHECKED + 2):
            if len(nodes) > 1:
                yield _stars(nodes, families(np.stack(checked, axis=1).view(np.uint64), similarity), ["a", "b"])

    names = ["key", "node", *(f"print{k}" for k in range(CHECKED))]
    met = distinct.select("node", "prints").mapInArrow(spread, ", ".join(f"{n} long" for n in names))
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def in_parts(family: DataFrame, part: int) -> DataFrame:
    """``key, node``: groups of at most about ``2 * part`` nodes in which every two nodes of a ``family`` meet."""
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / F.lit(part)).alias("parts"))
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.col("other")
    met = family.join(sizes, "family").withColumn("own", own).withColumn("other", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return met.where((F.col("parts") == 1) | (other != F.col("own"))).select(
        F.xxhash64("family", F.least("own", other), F.greatest("own", other)).alias("key"), "node")


def _confirmed(words_in_shingle: int, similarity: float):
    """Edges ``a, b`` that keep the components of every group, for rows ``key, node, text`` sorted by key."""

    def confirm(batches):
        for nodes, texts in _groups(batches, 3):
            if len(nodes) == 1:
                continue
            sets = [shingle_hashes((text or "").encode(), words_in_shingle)[1] for text in texts]
            found = np.array(linked(sets, similarity), np.int64).reshape(-1, 2)
            yield _stars(nodes, _merged(np.arange(len(nodes)), *found.T), ["a", "b"])

    return confirm


def keep_one(docs: DataFrame, words_in_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near copies, unchanged: the one with the smallest ``doc_id``.

    ``docs`` is counted first, for the width of the blocks.
    """
    row, node, prints = (spare(name, docs) for name in ("row", "node", "prints"))
    blocks, width, number = layout(docs.count(), similarity)
    marked = stage(_with_fingerprints(docs, node, prints, number, words_in_shingle).withColumn(
        row, F.monotonically_increasing_id()), "fingerprinted")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"),
                    F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    distinct = stage(marked.groupBy(F.col(node).alias("node"), F.col(prints).alias("prints")).agg(
        F.min(rank).alias("best")).select("node", "prints", "best", F.col("best.row").alias("row")), "distinct-texts")
    family = components.roots(candidates(distinct, similarity, blocks, width)).withColumnRenamed("root", "family")
    texts = marked.select(F.col(row).alias("row"), "text")
    members = (in_parts(family, PART).join(distinct.select("node", "row"), "node").join(texts, "row")
               .select("key", "node", "text"))
    root = components.roots(members.repartition("key").sortWithinPartitions("key").mapInArrow(
        _confirmed(words_in_shingle, similarity), "a long, b long"))
    named = distinct.select("node", "best").join(root, "node", "left")
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    return marked.join(kept.select(F.col("best.row").alias(row)), row, "left_semi").select(docs.columns)
