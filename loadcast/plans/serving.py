"""Forecast services as batch jobs over any number of input rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.calendar import calendar_features
from loadcast.functions.thermal import (coherent_max, coherent_min, cooling_degrees,
                                        heating_degrees, hours_above)
from loadcast.models.trees import Package
from loadcast.operators.grid import complete_period, seed_missing
from loadcast.operators.industrial import industrial_daily, monthly_anchors
from loadcast.operators.reports import temperature_sweep, with_region_name
from loadcast.plans.dataset import day_bounds
from loadcast.schema import (CLIMATE_INPUTS, DAY, HOT_HOUR, INDUSTRIAL, PUBLICATION_LAG_MONTHS,
                             REGIONS, RUN_UP_DAYS, SUB)
from loadcast.session import written

SETTLED_DAYS = 366          # a year and a day: from then on a flat level has no annual change


def unknown_regions(inputs: DataFrame) -> DataFrame:
    return inputs.filter(F.col(SUB).isNull() | ~F.col(SUB).isin(REGIONS)).select(SUB).distinct()


def fill_region_median(inputs: DataFrame, medians: DataFrame) -> DataFrame:
    """Missing climate cells, or whole missing columns, take the region's median."""
    small = medians.filter(F.col(SUB).isin(REGIONS)).select(
        SUB, *[F.col(c).alias(f"med_{c}") for c in CLIMATE_INPUTS if c in medians.columns])
    joined = inputs.join(F.broadcast(small), SUB, "left")       # one row per region, at most five
    have, known = set(inputs.columns), set(medians.columns)
    filled = {}
    for c in CLIMATE_INPUTS:
        options = ([F.col(c).cast("double")] if c in have else []) + (
            [F.col(f"med_{c}")] if c in known else [])
        filled[c] = F.coalesce(*options) if options else F.lit(None).cast("double")
    return joined.withColumns(filled).drop(*[f"med_{c}" for c in known])


def serving_industrial(inputs: DataFrame, monthly: DataFrame,
                       lag_months: int = PUBLICATION_LAG_MONTHS) -> DataFrame:
    """Industrial level and annual change over the asked dates, with a run-up of 400 days."""
    return industrial_daily(monthly, *day_bounds(inputs), lag_months, run_up_days=RUN_UP_DAYS)


def industrial_series(monthly: DataFrame, lag_months: int = PUBLICATION_LAG_MONTHS) -> DataFrame:
    """Industrial level and annual change for every day on which either can move.

    The level is flat and the change zero from a year after the last anchor on, and up to the first one. So
    the series is as long as the published months, whatever dates are asked of it.
    """
    span = monthly_anchors(monthly, lag_months).agg(F.struct(
        F.date_sub(F.min("anchor"), SETTLED_DAYS).alias("lo"), F.date_add(F.max("anchor"), SETTLED_DAYS).alias("hi"))).scalar()
    return industrial_daily(monthly, span["lo"], span["hi"], lag_months)


def with_industrial(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Each row with the series at its day; days outside the series take its nearest end."""
    lo, hi = day_bounds(series)
    at = series.withColumnRenamed(DAY, "_at")
    return rows.withColumn("_at", F.greatest(F.least(DAY, hi), lo)).join(at, [SUB, "_at"], "left").drop("_at")


def require_known_regions(inputs: DataFrame) -> None:
    """Raise if a row names no known region. Runs one job over the region column."""
    labels = [r[0] for r in unknown_regions(inputs).limit(5).collect()]
    if labels:
        raise ValueError(f"unknown region: {labels}; use one of {REGIONS}")


def serving_features(inputs: DataFrame, medians: DataFrame, monthly: DataFrame,
                     lag_months: int = PUBLICATION_LAG_MONTHS, validated: bool = False) -> DataFrame:
    """All features from a minimal input: region, date and whatever climate is known.

    ``validated`` inputs, such as those of ``normalize_inputs``, skip the region check.
    """
    if not validated:
        require_known_regions(inputs)
    df = fill_region_median(inputs, medians)
    mean = F.col("temp_mean")
    df = df.withColumns({"temp_max": coherent_max(F.col("temp_max"), mean),
                         "temp_min": coherent_min(F.col("temp_min"), mean)})
    df = calendar_features(df).withColumns({
        "graus_refrig": cooling_degrees(mean),
        "graus_aquec": heating_degrees(mean),
        "amplitude_termica": F.col("temp_max") - F.col("temp_min"),
        "horas_acima_26": hours_above(HOT_HOUR, mean, F.col("temp_max"), F.col("temp_min"))})
    given = lambda c, default: F.coalesce(F.col(c), F.col(default)) if c in inputs.columns else F.col(default)
    df = df.withColumns({"graus_refrig_med3": given("graus_refrig_med3", "graus_refrig"),
                         "temp_mean_ontem": given("temp_mean_ontem", "temp_mean")})
    # written, so that Spark joins by its true size; the input rows are read once
    return with_industrial(df.drop(*INDUSTRIAL), written(industrial_series(monthly, lag_months)))


def forecast(inputs: DataFrame, package: Package, medians: DataFrame, monthly: DataFrame,
             lag_months: int = PUBLICATION_LAG_MONTHS, validated: bool = False) -> DataFrame:
    """Forecast with its decomposition and the region's name.

    A row id column, if the inputs have one, is carried through for restoring their order.
    """
    features = serving_features(inputs, medians, monthly, lag_months, validated)
    return with_region_name(package.decompose(features))


def year_inputs(year: int, wanted: DataFrame, normal: DataFrame,
                climate: DataFrame | None = None) -> DataFrame:
    """Climate for every day of a year: supplied cells, else climatology.

    Without supplied climate the seeding row is not data, so every day is marked as climatology.
    """
    first_day, last_day = f"{year}-01-01", f"{year}-12-31"
    if climate is None:
        seeds = wanted.withColumn(DAY, F.lit(first_day).cast("date"))
        return (complete_period(seeds, normal, [DAY], first_day, last_day)
                .withColumn("origem", F.lit("climatologia")))
    seeded = seed_missing(wanted, climate, first_day)
    return complete_period(seeded, normal, [DAY], first_day, last_day)


def project_year(year: int, wanted: DataFrame, normal: DataFrame, package: Package,
                 medians: DataFrame, monthly: DataFrame,
                 climate: DataFrame | None = None) -> DataFrame:
    return forecast(year_inputs(year, wanted, normal, climate), package, medians, monthly)


def response_curve(scenarios: DataFrame, history: DataFrame, package: Package, medians: DataFrame,
                   monthly: DataFrame, steps: int = 60) -> DataFrame:
    """Forecast over a temperature sweep with everything else fixed."""
    return forecast(temperature_sweep(scenarios, history, steps), package, medians, monthly)
