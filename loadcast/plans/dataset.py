"""The model dataset, end to end, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.calendar import calendar_features
from loadcast.operators.industrial import industrial_daily
from loadcast.operators.national import with_national
from loadcast.operators.series import autoregressive_features, thermal_inertia
from loadcast.schema import DAY, NATIONAL, PUBLICATION_LAG_MONTHS, SUB


def day_bounds(rows: DataFrame) -> tuple[Column, Column]:
    """First and last day of a table as scalar subqueries over one shared aggregate."""
    span = rows.agg(F.struct(F.min(DAY).alias("lo"), F.max(DAY).alias("hi"))).scalar()
    return span["lo"], span["hi"]


def panel(load: DataFrame, climate: DataFrame, monthly: DataFrame,
          lag_months: int = PUBLICATION_LAG_MONTHS, mode: str = "linear",
          run_up_days: int = 0) -> DataFrame:
    """Load with climate and industrial level; load days without a match are kept."""
    industrial = industrial_daily(monthly, *day_bounds(load), lag_months, mode, run_up_days)
    return join_panel(load, climate, industrial)


def join_panel(load: DataFrame, climate: DataFrame, industrial: DataFrame) -> DataFrame:
    return load.join(climate, [SUB, DAY], "left").join(industrial, [SUB, DAY], "left")


def missing_climate(panel_rows: DataFrame) -> DataFrame:
    """Days per region that found no climate."""
    return panel_rows.groupBy(SUB).agg(F.count_if(F.col("temp_mean").isNull()).alias("dias_sem_clima"))


def add_features(rows: DataFrame) -> DataFrame:
    return autoregressive_features(thermal_inertia(calendar_features(rows)))


def build_dataset(load: DataFrame, climate: DataFrame, monthly: DataFrame, reference_year: int,
                  lag_months: int = PUBLICATION_LAG_MONTHS, mode: str = "linear",
                  run_up_days: int = 0, own_national_change: bool = False) -> DataFrame:
    """Panel, national rows and all features.

    National rows are added before the derived features so they get the same lags. Their annual
    industrial change is the load-weighted mean of the subsystems' changes, or with
    ``own_national_change`` the change of the national sum, as forecast inputs have it.
    """
    industrial = industrial_daily(monthly, *day_bounds(load), lag_months, mode, run_up_days)
    rows = with_national(join_panel(load, climate, industrial), reference_year)
    if own_national_change:
        own = (industrial.filter(F.col(SUB) == NATIONAL)
               .select(SUB, DAY, F.col("industrial_var_anual").alias("_own")))
        rows = (rows.join(own, [SUB, DAY], "left")
                .withColumn("industrial_var_anual", F.coalesce("_own", "industrial_var_anual"))
                .drop("_own"))
    return add_features(rows)
