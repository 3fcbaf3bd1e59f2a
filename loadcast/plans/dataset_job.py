"""Input files to the model dataset, kept by year; only years that see a change in the files are built again.

A change in one year reaches others: lags read the seven rows before, the industrial level runs between the anchors on both
sides, its annual change reads the day a year before, and national shares come from one reference year. All that reaches
the driver is a row per calendar year, per subsystem, or per changed year.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadcast.operators.industrial import industrial_daily, monthly_anchors
from loadcast.operators.national import load_shares, national_rows
from loadcast.operators.series import by_sub
from loadcast.plans.dataset import add_features, join_panel
from loadcast.schema import DAY, NATIONAL, PUBLICATION_LAG_MONTHS, SUB, SUBSYSTEMS
from loadcast.session import settle
from loadcast.sources.sinks import MANIFEST, YEAR, cached_years, changed_years, manifest, read_by_year, write_by_year

LAG_ROWS = 7
CHANGE_DAYS = 365
LONG_AGO = date(1000, 1, 1)
SOURCE = "fonte"


@dataclass(frozen=True)
class Source:
    """One kind of input files: a folder a year, and what a year's files are reduced to (day or month x region)."""

    folders: dict[int, str]
    glob: str
    reduce: Callable[[int], DataFrame]


def reduced(spark: SparkSession, source: Source, path: str) -> DataFrame:
    """All years of a source; a year's files are read again only when they changed."""
    cached_years(spark, path, source.folders, source.glob, lambda year: source.reduce(year).drop(YEAR))
    return read_by_year(spark, path, list(source.folders))


def row_years(load: DataFrame) -> list:
    """For every year with load its first day, and the earliest day that its rows' lags read, over regions and nation.

    ``reach`` is that day where all rows have seven rows before them, else long ago; ``start`` is it, or a region's first day.
    """
    national = (load.filter(F.col(SUB).isin(SUBSYSTEMS)).groupBy(DAY).agg(F.countDistinct(SUB).alias("n"))
                .filter(F.col("n") == len(SUBSYSTEMS)).select(F.lit(NATIONAL).alias(SUB), DAY))
    before = F.lag(DAY, LAG_ROWS).over(by_sub())
    rows = load.select(SUB, DAY).unionByName(national).select(
        DAY, F.coalesce(before, F.lit(LONG_AGO)).alias("reach"),
        F.coalesce(before, F.min(DAY).over(Window.partitionBy(SUB))).alias("start"))
    return (rows.groupBy(F.year(DAY).alias(YEAR)).agg(*[F.min(c).alias(c) for c in (DAY, "reach", "start")])
            .orderBy(YEAR).collect())


def industrial_reach(monthly: DataFrame, changed: list[int], lag_months: int) -> list[tuple[date | None, date | None]]:
    """For each changed year of monthly data the unchanged anchors around it, whose segments it moves; None is open."""
    anchors = monthly_anchors(monthly.filter(~F.col(YEAR).isin(changed)), lag_months)
    found = []
    for year in changed:
        first, last = (F.add_months(F.lit(date(year, month, 15)), lag_months) for month in (1, 12))
        sides = anchors.groupBy(SUB).agg(F.max(F.when(F.col("anchor") < first, F.col("anchor"))),
                                         F.min(F.when(F.col("anchor") > last, F.col("anchor")))).collect()
        known = {r[0]: (r[1], r[2]) for r in sides}
        befores, afters = zip(*(known.get(s, (None, None)) for s in SUBSYSTEMS))
        found.append((None if None in befores else min(befores), None if None in afters else max(afters)))
    return found


def touched_years(years: list, load_changed: list[int], climate_changed: list[int],
                  industrial: list[tuple[date | None, date | None]], reference_year: int) -> list[int]:
    """The years with rows that may differ from what was built before the changes."""
    present = [r[YEAR] for r in years]
    if reference_year in load_changed or (load_changed and reference_year not in present):
        return present
    found = {r[YEAR] for r in years for y in {*load_changed, *climate_changed}
             if r["reach"].year <= y <= r[YEAR]}
    spans = [(before or date.min, after + timedelta(CHANGE_DAYS) if after else date.max) for before, after in industrial]
    kept = [r[DAY] for r in years if r[YEAR] not in load_changed]
    # the first year of a series has no annual change, so a series that may begin on another day moves that year
    if kept and load_changed and min(load_changed) <= min(kept).year:
        spans.append((date.min, min(kept) + timedelta(CHANGE_DAYS - 1)))
    elif load_changed and not kept:
        return present
    return sorted(found | {y for y in present for lo, hi in spans if lo.year <= y <= hi.year})


def day_ranges(years: list, wanted: list[int]) -> list[tuple[date, date]]:
    """Days to read so that the wanted years have all rows that their lags need; ranges that meet are joined."""
    ranges: list[tuple[date, date]] = []
    for r in years:
        if r[YEAR] in wanted:
            lo, hi = r["start"], date(r[YEAR], 12, 31)
            while ranges and lo <= ranges[-1][1] + timedelta(1):
                lo = min(lo, ranges.pop()[0])
            ranges.append((lo, hi))
    return ranges


def rows_of_ranges(load: DataFrame, climate: DataFrame, monthly: DataFrame, ranges: list[tuple[date, date]],
                   reference_year: int, lag_months: int, mode: str, run_up_days: int) -> DataFrame:
    """The dataset's rows on some days; the first seven rows of a range serve the lags of the others."""
    lo = load.agg(F.min(DAY)).first()[0] - timedelta(run_up_days)
    inside = lambda days: reduce(lambda a, b: a | b, [F.col(DAY).between(F.lit(a), F.lit(b)) for a, b in days])
    levels = [industrial_daily(monthly, F.lit(max(lo, first - timedelta(CHANGE_DAYS))), F.lit(last), lag_months, mode)
              .filter(inside([(first, last)])) for first, last in ranges]
    panel = join_panel(load.filter(inside(ranges)), climate.filter(inside(ranges)), reduce(DataFrame.unionByName, levels))
    national = national_rows(panel, load_shares(load, reference_year))
    return add_features(panel.unionByName(national, allowMissingColumns=True))


def dataset_of_years(spark: SparkSession, sources: dict[str, Source], root: str, reference_year: int,
                     lag_months: int = PUBLICATION_LAG_MONTHS, mode: str = "linear",
                     run_up_days: int = 0) -> tuple[DataFrame, list[int]]:
    """The dataset, and the years that were built. ``sources``: ``load``, ``climate`` and ``monthly``.

    What the dataset was last built from is written after its rows, so a build that fails is done again.
    Other settings than before need another ``root``.
    """
    built_from, path = f"{root}/manifest", f"{root}/dataset"
    now = settle(reduce(DataFrame.unionByName, [manifest(spark, s.folders, s.glob).withColumn(SOURCE, F.lit(name))
                                                for name, s in sources.items()]))
    try:
        old = spark.read.schema(f"{MANIFEST}, {SOURCE} string").parquet(built_from)
        old.limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    load, climate, monthly = (reduced(spark, sources[name], f"{root}/{name}") for name in ("load", "climate", "monthly"))
    load, climate, monthly = load.drop(YEAR), climate.drop(YEAR), monthly.withColumn(YEAR, F.col(YEAR).cast("int"))
    years = row_years(load)
    if not years:
        raise ValueError("the load files hold no rows of a known subsystem")
    if old is None:
        wanted = [r[YEAR] for r in years]
    else:
        changed = {name: changed_years(old.filter(F.col(SOURCE) == name), now.filter(F.col(SOURCE) == name))
                   for name in sources}
        wanted = touched_years(years, changed["load"], changed["climate"],
                               industrial_reach(monthly, changed["monthly"], lag_months), reference_year)
    if wanted:
        rows = rows_of_ranges(load, climate, monthly, day_ranges(years, wanted), reference_year, lag_months, mode, run_up_days)
        write_by_year(rows.filter(F.col(YEAR).isin(wanted)), path)
    if old is None or wanted or any(changed.values()):
        now.coalesce(1).write.mode("overwrite").parquet(built_from)
    # a year whose load is gone leaves its old folder behind, which is not read
    return read_by_year(spark, path, [r[YEAR] for r in years]).withColumn(YEAR, F.col(YEAR).cast("int")), wanted
