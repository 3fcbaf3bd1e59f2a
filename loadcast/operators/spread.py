"""Order, medians and carried values over tables of any size: no window, sort or buffer holds a whole table or group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcast.session import settle, written

RANGE, LINE, BEFORE, HEAD = "_faixa", "_linha", "_antes", "_inicio"
BUCKETS = 1024


def dense_positions(df: DataFrame, order: list[str], name: str = "posicao", ranges: int | None = None) -> DataFrame:
    """Adds the place of each row, from 1 without gaps, in the order of some columns; nulls come first, ties in any order.

    Rows are split into ranges of the order and written, so that no second run of the split can differ. A row's place is
    its number inside its range plus the rows of the ranges before, of which there is one count each. Rows that tie
    are split too, as their number in the input is part of the order.
    """
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, LINE]
    ranged = written(df.withColumn(LINE, F.monotonically_increasing_id()).repartitionByRange(count, *keys)
                     .withColumn(RANGE, F.spark_partition_id()))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)          # one row a range
    offsets = (ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"))
               .select(RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(BEFORE)))
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*keys))
    return (ranged.join(F.broadcast(offsets), RANGE)            # one row a range, whose number is asked for above
            .withColumn(name, inside + F.col(BEFORE)).drop(RANGE, LINE, BEFORE))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on groups; a missing key is a group like any other."""
    other = right.withColumnsRenamed({k: f"_chave_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_chave_{k}")) for k in keys])
    return left.join(other, match).drop(*[f"_chave_{k}" for k in keys])


def exact_medians(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The exact median of every group, by counting in value ranges; missing values take no part.

    A group's two middle places are looked for at once. Each round counts the values of 1024 equal parts of the range that holds
    a place, and the part with the place becomes the range; its ends are values that occur, so a round always narrows it,
    until both ends are the same. Each task sends at most one count a part, group and place.
    """
    value = F.col(column).cast("double")
    rows = df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    found = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array_distinct(F.array(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)))
    targets = settle(found.select(*keys, F.explode(places).alias("_place"), F.lit(0).cast("long").alias("_skip"), "_lo", "_hi"))
    still = F.col("_lo") < F.col("_hi")
    while not targets.filter(still).isEmpty():
        wanted = targets.filter(still)
        # the ends have parts of their own, so each round takes them off even where a width is no finite number
        share = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        part = (F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), BUCKETS)
                .when(F.isnan(share), 0).otherwise(F.least(F.lit(BUCKETS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS))))
        inside = (join_groups(rows, wanted, keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                  .select(*keys, "_place", "_skip", "_v", part.cast("int").alias("_part")))
        counts = inside.groupBy(*keys, "_place", "_skip", "_part").agg(
            F.count("_v").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_place").orderBy("_part"))     # at most 1026 parts
        narrowed = (counts.withColumn("_to", F.col("_skip") + upto)
                    .filter((F.col("_to") - F.col("_c") < F.col("_place")) & (F.col("_place") <= F.col("_to")))
                    .select(*keys, "_place", (F.col("_to") - F.col("_c")).alias("_skip"), "_lo", "_hi"))
        targets = settle(targets.filter(~still).unionByName(narrowed))
    return targets.groupBy(*keys).agg(F.avg("_lo").alias(column))


def carry_long(df: DataFrame, keys: list[str], chunk: str, order: list[str], column: str) -> DataFrame:
    """Fills gaps of a series with its last known value, else with its first one, however long the series is.

    ``chunk`` splits a series along its order (a day, a month), so it must never fall along it. Only one row a chunk, its first
    and last known value, is in a window over the whole series; rows are in windows over their chunk. What a chunk starts with,
    the last value known before it, else the series' first one, is a row before its others, so each window runs forward
    once: a frame up to a window's end is summed anew for each row, with the square of its rows.
    """
    known = F.col(column).isNotNull()
    place = F.struct(*order)
    ends = df.groupBy(*keys, chunk).agg(F.min_by(F.when(known, F.col(column)), F.when(known, place)).alias("_first"),
                                        F.max_by(F.when(known, F.col(column)), F.when(known, place)).alias("_last"))
    along = Window.partitionBy(*keys).orderBy(chunk)
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = ends.select(*keys, chunk, F.lit(True).alias(HEAD), F.coalesce(
        F.last("_last", ignorenulls=True).over(past), F.first("_first", ignorenulls=True).over(whole)).alias(column))
    rows = df.withColumn(HEAD, F.lit(False)).unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy(*keys, chunk).orderBy(F.desc(HEAD), *order)
    here = F.last(column, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(column, here).filter(~F.col(HEAD)).drop(HEAD)
