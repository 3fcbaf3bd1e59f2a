"""Connected components of a graph given as edges, by alternating stars.

Every round links all neighbours of a node to the smallest of them. Minima are aggregates and links are
joins, so a node with very many neighbours is folded on the map side or split by adaptive joins, and no
group is ever gathered. Rounds grow with the logarithm of the longest chain; each is written to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _smallest(edges: DataFrame, group: str, other: str) -> DataFrame:
    return edges.groupBy(group).agg(F.least(F.min(other), F.col(group)).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (both.join(_smallest(both, "a", "b"), "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_smallest(down, "a", "b"), "a")
    return (joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(joined.select("a", F.col("low").alias("b"))).where("a <> b").distinct())


def roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``); the root is the smallest node.

    Loops and repeated edges are allowed, an empty table gives an empty one.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "edges")
    mark = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(found.select("root", "root").distinct())
