"""Medians, climatology and completion of partly supplied periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.operators.quality import keep_last
from loadcast.operators.series import fill_both_ways
from loadcast.schema import CLIMATE_INPUTS, CLIMATOLOGY_WINDOW, DAY, REGIONS, SUB
from loadcast.session import settle

DOY = "dia_ano"


def _inputs_in(df: DataFrame) -> list[str]:
    return [c for c in CLIMATE_INPUTS if c in df.columns]


def region_medians(history: DataFrame) -> DataFrame:
    """Median of each climate input per region: one row per region."""
    return history.groupBy(SUB).agg(*[F.median(c).alias(c) for c in _inputs_in(history)])


def climatology_raw(history: DataFrame) -> DataFrame:
    """Median climate of each day of the year."""
    return (history.groupBy(SUB, F.dayofyear(DAY).alias(DOY))
            .agg(*[F.median(c).alias(c) for c in _inputs_in(history)]))


def climatology(history: DataFrame, window: int = CLIMATOLOGY_WINDOW) -> DataFrame:
    """Climatology smoothed by a centred rolling median that wraps round the year's end.

    Each region's year (at most 366 rows) is laid out three times; the middle copy is kept.
    """
    raw = climatology_raw(history)
    half = window // 2
    frame = (Window.partitionBy(SUB).orderBy("copy", DOY).rowsBetween(-half, half))
    tripled = raw.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    smooth = tripled.select(SUB, DOY, "copy",
                            *[F.percentile(c, F.lit(0.5)).over(frame).alias(c)
                              for c in _inputs_in(history)])
    return smooth.filter(F.col("copy") == 1).drop("copy")


def climatology_with_fallback(normal: DataFrame, regions: DataFrame) -> DataFrame:
    """Climatology for the wanted regions; one without history gets the median of all regions."""
    pooled = normal.groupBy(DOY).agg(*[F.median(c).alias(c) for c in _inputs_in(normal)])
    unknown = regions.join(normal.select(SUB).distinct(), SUB, "left_anti")
    # at most the codes of the region dictionary; any other one has been refused before
    codes = unknown.filter(F.col(SUB).isin(REGIONS)).agg(F.collect_list(SUB).alias("codes")).scalar()
    fallback = pooled.withColumn(SUB, F.explode(codes))
    known = normal.join(regions, SUB, "left_semi")
    return known.unionByName(fallback)


def daily_grid(regions: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Every day between two bounds for each region, expanded on the executors."""
    return regions.select(SUB, F.explode(F.sequence(first_day, last_day)).alias(DAY))


def period_bounds(inputs: DataFrame, since: str | None = None,
                  until: str | None = None) -> DataFrame:
    """One row (lo, hi): given bounds, else the first supplied day and 31 December of the last year."""
    lo = F.lit(since).cast("date") if since else F.min(DAY)
    hi = (F.lit(until).cast("date") if until
          else F.make_date(F.year(F.max(DAY)), F.lit(12), F.lit(31)))
    return inputs.agg(lo.alias("lo"), hi.alias("hi"))


def complete_period(inputs: DataFrame, normal: DataFrame, order: list[str],
                    since: str | None = None, until: str | None = None) -> DataFrame:
    """Extend inputs to a whole period: supplied cells win, the rest is climatology.

    ``order`` names the columns that decide which of several rows for one day is the last.
    ``origem`` tells supplied days from estimated ones. Days outside the period are dropped; an
    end before the start and an unknown region are errors, raised when the job runs.
    """
    cols = _inputs_in(normal)
    given = [c for c in cols if c in inputs.columns]
    # collapse duplicates in one pass over the raw inputs and keep the result: what follows reads
    # at most one row per region and day, several times
    extra = [c for c in order if c not in (SUB, DAY, *given)]
    stray = F.raise_error(F.concat(F.lit("unknown region: "), F.coalesce(SUB, F.lit("none"))))
    region = F.when(F.col(SUB).isin(REGIONS), F.col(SUB)).otherwise(stray.cast("string")).alias(SUB)
    supplied = settle(keep_last(inputs.select(SUB, DAY, *given, *extra), [SUB, DAY], order)
                      .select(region, DAY, *[F.col(c).alias(f"u_{c}") for c in given]))
    span = period_bounds(supplied, since, until).select(F.struct("lo", "hi")).scalar()
    lo, hi = span["lo"], span["hi"]
    hi = F.when(hi < lo, F.raise_error(F.lit("the last day is before the first")).cast("date")).otherwise(hi)
    regions = supplied.select(SUB).distinct()
    grid = daily_grid(regions, lo, hi).withColumn(DOY, F.dayofyear(DAY))
    filled = (grid.join(climatology_with_fallback(normal, regions), [SUB, DOY], "left")
              .select(SUB, DAY, *[fill_both_ways(F.col(c)).alias(c) for c in cols]))
    marked = supplied.withColumn("_supplied", F.lit(True))
    value = {c: F.coalesce(F.col(f"u_{c}"), F.col(c)) if c in given else F.col(c) for c in cols}
    return (filled.join(marked, [SUB, DAY], "left")
            .select(SUB, DAY, *[v.alias(c) for c, v in value.items()],
                    F.when(F.col("_supplied"), "arquivo").otherwise("climatologia").alias("origem")))


def missing_regions(wanted: DataFrame, supplied: DataFrame) -> DataFrame:
    """Wanted regions without a supplied row."""
    return wanted.join(supplied.select(SUB).distinct(), SUB, "left_anti")


def seed_missing(wanted: DataFrame, supplied: DataFrame, first_day: str) -> DataFrame:
    """Supplied rows of the wanted regions, plus an empty first-day row for each absent one."""
    kept = supplied.join(wanted, SUB, "left_semi")
    seeds = missing_regions(wanted, supplied).withColumn(DAY, F.lit(first_day).cast("date"))
    return kept.unionByName(seeds, allowMissingColumns=True)
