"""Shards by a weighted hash tree of regions, racks and shards.

A row descends from the root: at every level each child draws ``-ln(u) / weight``, with ``u`` hashed from the
row's key and the child's name, and the smallest draw wins. A child is chosen in proportion to its weight,
and its draw changes only when its own weight does, so a change moves rows only into or out of the subtrees whose
weights changed. A shard that is added in a region of its own takes rows only into itself.

Only DataFrame functions are used. Places inside a shard are a running sum over counted rows: equal rows
are folded on the map side first, and a shard is numbered in ``BUCKETS`` independent ranges.

Defined cases: a null ``doc_id`` is a key of its own, so all such rows share a shard; a null text has no
bytes; repeated rows share a shard and get slots one after the other; an empty table gives an empty one;
other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

#: Hex digits of the key's hash that number the ranges of a shard: 4096 of them.
BUCKET_DIGITS = 3
#: Region, then rack, then shard, with the weight of each shard.
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(regions: int = 4, racks: int = 2, shards: int = 2) -> Tree:
    """Shards numbered from 0, each of weight 1."""
    return {f"region{r}": {f"rack{r}.{k}": {(r * racks + k) * shards + s: 1.0 for s in range(shards)}
                           for k in range(racks)} for r in range(regions)}


def with_new_shard(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own: rows move only into it."""
    number = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    region = f"region{len(tree)}"
    return tree | {region: {f"rack{len(tree)}.0": {number: weight}}}


def row_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _draw(key: Column, children: dict[str, float]) -> Column:
    def score(name: str, weight: float) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, 13), 16, 10)
        return -F.ln((digits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))

    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*(F.struct(score(n, w).alias("draw"), F.lit(n).alias("name"))
                                 for n, w in children.items())))["name"]


def _case(of: Column, branches: dict[str, Column]) -> Column:
    chosen = F
    for name, column in branches.items():
        chosen = chosen.when(of == name, column)
    return chosen


def descend(rows: DataFrame, tree: Tree, key: str, out: str) -> DataFrame:
    """Add column ``out``, the shard that the draws of ``key`` lead to."""
    weigh = lambda shards: sum(shards.values())
    region, rack = f"{out}_region", f"{out}_rack"
    column = F.col(key)
    rows = rows.withColumn(region, _draw(column, {n: sum(map(weigh, racks.values())) for n, racks in tree.items()}))
    rows = rows.withColumn(rack, _case(F.col(region), {
        n: _draw(column, {k: weigh(s) for k, s in racks.items()}) for n, racks in tree.items()}))
    rows = rows.withColumn(out, _case(F.col(rack), {
        k: _draw(column, {f"shard{n}": w for n, w in s.items()}) for racks in tree.values()
        for k, s in racks.items()}))
    return rows.withColumn(out, F.substring(out, 6, 10).cast("int")).drop(region, rack)


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and ``grown_shard`` (null without ``grown``) of every row.

    Slots of a shard are gapless from 0, in the order of the key's hash range, ``doc_id`` (null first),
    checksum and size.
    """
    rows = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
                       F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), row_key().alias("key"))
    counted = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("rows"))
    counted = descend(counted, tree, "key", "shard")
    counted = (descend(counted, grown, "key", "grown_shard") if grown
               else counted.withColumn("grown_shard", F.lit(None).cast("int")))
    counted = stage(counted.withColumn("bucket", F.substring(F.md5(F.col("key").cast("binary")), 1,
                                                             BUCKET_DIGITS)).drop("key"), "sharded")
    ranges = counted.groupBy("shard", "bucket").agg(F.sum("rows").alias("rows"))
    before = ranges.select("shard", "bucket", (F.sum("rows").over(
        Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (counted.withColumn("inside", F.sum("rows").over(inside) - F.col("rows"))
              .join(before, ["shard", "bucket"])
              .withColumn("first", F.col("before") + F.col("inside")))
    return placed.select("doc_id", "size", "text_crc32", "shard", F.explode(
        F.sequence("first", F.col("first") + F.col("rows") - 1)).alias("slot"), "grown_shard")
