"""SimHash near-duplicates: pigeonhole blocks, then the exact Hamming distance.

A fingerprint is cut into ``blocks`` blocks. Two fingerprints that differ in at most ``distance`` bits
agree on at least ``blocks - distance`` whole blocks, so every choice of that many blocks is a key and close
pairs share one. Keys are looked up over distinct fingerprints only, so exact copies never meet.

* A key of two fingerprints is a pair, taken from the aggregate itself.
* A key of up to ``group_bound`` fingerprints is compared in one task, which returns a star for each of
  its components, not its pairs.
* Fingerprints of larger keys go another exact way: two of them are within ``distance`` (even) bits
  if and only if some value is within half of that of both. Each is listed under all such values,
  and all that share a value are linked to the smallest. The work is linear in the number of fingerprints.

``blocks`` grows with the number of distinct fingerprints so that chance meetings stay in proportion;
every choice finds the same links.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle; repeated rows are repeated in the result; the component
is the smallest ``doc_id`` that is not null; an empty table gives an empty one; other columns, whatever their names,
are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components
from .common import spare, stage

GROUP_BOUND = 2048


def fingerprint(text: bytes, words_in_shingle: int = 4, seed: int = 42) -> int:
    """64 bits, each set where over half of the shingles' hashes have it."""
    import xxhash

    words = text.lower().split()              # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words_in_shingle, len(words))
    starts, stops = (ends - sizes)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for begin in range(0, len(starts), 8192):
        hashes = np.array([digest(joined[a:b], seed) for a, b in
                           zip(starts[begin:begin + 8192], stops[begin:begin + 8192])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, words_in_shingle: int = 4, out: str = "bits") -> DataFrame:
    """``docs`` (columns kept) with ``out``, the fingerprint of ``text`` as a signed long."""
    place = docs.columns.index("text")

    def compute(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            bits = [fingerprint(t.as_py() or b"", words_in_shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array(bits, np.uint64).view(np.int64))], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])
    names = schema.names
    return docs.mapInArrow(compute, schema)


def fingerprints(docs: DataFrame, words_in_shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``bits`` of every row."""
    return with_fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words_in_shingle).drop("text")


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of ``blocks - distance`` blocks of 64 bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def enough_blocks(fingerprint_count: int, distance: int) -> int:
    """The fewest blocks with which a fingerprint meets about one other by chance, or fewer."""
    for blocks in range(distance + 3, distance + 7):
        masks = block_masks(blocks, distance)
        if len(masks) * fingerprint_count < 1 << min(m.bit_count() for m in masks):
            break
    return blocks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _stars(distance: int):
    """Links that keep the components of every key, for rows sorted by key."""

    def of_group(bits: np.ndarray) -> list[tuple[int, int]]:
        unsigned = bits.view(np.uint64)           # bitwise_count takes the absolute value of signed numbers
        near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= distance
        label = np.arange(len(bits))
        while True:
            low = np.where(near, label, len(bits)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        return [(int(bits[i]), int(bits[r])) for i, r in enumerate(label) if i != r]

    def link(batches):
        key, held = None, []
        for batch in batches:
            keys, bits = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges = []
            for own_key, own in zip(keys[np.concatenate([[0], cuts])] if len(keys) else [],
                                    np.split(bits, cuts)):
                if own_key != key:
                    edges += of_group(np.concatenate(held)) if held else []
                    key, held = own_key, []
                held.append(own)
            yield batch_of(edges)
        yield batch_of(of_group(np.concatenate(held)) if held else [])

    def batch_of(edges):
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)],
                                          names=["a", "b"])

    return link


def links(distinct: DataFrame, distance: int = 4, group_bound: int = GROUP_BOUND,
          blocks: int | None = None) -> DataFrame:
    """Edges ``a, b`` with the components of all pairs of ``bits`` within ``distance``.

    ``distinct`` is a written table of distinct ``bits``.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    blocks = blocks or enough_blocks(distinct.count(), distance)
    keyed = distinct.select("bits", F.explode(F.array(*(
        F.xxhash64(F.lit(k), F.col("bits").bitwiseAND(F.lit(_signed(mask))))
        for k, mask in enumerate(block_masks(blocks, distance))))).alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("bits").alias("a"),
                                            F.max("bits").alias("b")).where("n > 1"), "shared-keys")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = shared.where("n = 2").where(close).select("a", "b")
    members = stage(keyed.join(shared.where("n > 2").select("key", "n"), "key"), "key-members")
    starred = (members.where(F.col("n") <= group_bound).select("key", "bits").repartition("key")
               .sortWithinPartitions("key").mapInArrow(_stars(distance), "a long, b long"))
    found = pairs.union(starred)
    crowded = members.where(F.col("n") > group_bound).select("bits").distinct()
    if not crowded.isEmpty():
        found = found.union(_by_middle(stage(crowded, "crowded"), distance))
    return found.distinct()


def _by_middle(crowded: DataFrame, distance: int) -> DataFrame:
    flips = [_signed(sum(1 << b for b in bits)) for n in range(distance // 2 + 1)
             for bits in combinations(range(64), n)]
    listed = crowded.select("bits", F.explode(F.transform(
        F.array(*map(F.lit, flips)), lambda f: F.col("bits").bitwiseXOR(f))).alias("middle"))
    least = (listed.groupBy("middle").agg(F.min("bits").alias("a"), F.max("bits").alias("b"))
             .where("a < b").select("middle", "a"))
    return listed.join(least, "middle").where("a <> bits").select("a", F.col("bits").alias("b"))


def components_of(marked: DataFrame, distance: int = 4, group_bound: int = GROUP_BOUND) -> DataFrame:
    """``bits, component_id`` of every distinct fingerprint of a written table (``doc_id, bits``)."""
    distinct = stage(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    root = components.roots(links(distinct, distance, group_bound))
    rooted = distinct.join(root, distinct.bits == root.node, "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(named, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame, words_in_shingle: int = 4, distance: int = 4,
                    group_bound: int = GROUP_BOUND) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    marked = stage(fingerprints(docs, words_in_shingle), "fingerprints")
    return marked.join(components_of(marked, distance, group_bound), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_in_shingle: int = 4, distance: int = 4,
             group_bound: int = GROUP_BOUND) -> DataFrame:
    """One row of each component, unchanged: the one with the smallest ``doc_id``.

    Every task first drops all but its own best row of a component, so a large one is never gathered.
    """
    bits, root, nth = (spare(name, docs) for name in ("bits", "root", "nth"))
    marked = stage(with_fingerprints(docs, words_in_shingle, bits), "fingerprinted")
    found = components_of(marked.select("doc_id", F.col(bits).alias("bits")), distance, group_bound)
    best = Window.partitionBy(root).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    joined = marked.join(found.select(F.col("bits").alias(bits), F.col("root").alias(root)), bits)
    return joined.withColumn(nth, F.row_number().over(best)).where(F.col(nth) == 1).select(docs.columns)
