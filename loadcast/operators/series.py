"""Row-based time-series columns. Every window is per subsystem, ordered by day.

These run on day x region tables, whose groups are bounded by the calendar, never on raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loadcast.schema import DAY, LOAD, SUB


def by_sub() -> WindowSpec:
    return Window.partitionBy(SUB).orderBy(DAY)


def fill_both_ways(column: Column) -> Column:
    """Carry the last known value forward, then the first known one back."""
    window = by_sub()
    past = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.coalesce(F.last(column, ignorenulls=True).over(past),
                      F.first(column, ignorenulls=True).over(future))


def load_lags(df: DataFrame) -> DataFrame:
    return df.withColumns({"carga_ontem": F.lag(LOAD, 1).over(by_sub()),
                           "carga_lag7": F.lag(LOAD, 7).over(by_sub())})


def trailing_mean(df: DataFrame, rows: int = 7) -> DataFrame:
    """Mean of the previous rows, today excluded; null unless all of them have a value."""
    frame = by_sub().rowsBetween(-rows, -1)
    mean = F.when(F.count(LOAD).over(frame) == rows, F.avg(LOAD).over(frame))
    return df.withColumn("media_7d", mean)


def autoregressive_features(df: DataFrame) -> DataFrame:
    return trailing_mean(load_lags(df))


def thermal_inertia(df: DataFrame) -> DataFrame:
    """Daily range, three-row mean of cooling degrees and yesterday's mean temperature."""
    return df.withColumns({
        "amplitude_termica": F.col("temp_max") - F.col("temp_min"),
        "graus_refrig_med3": F.avg("graus_refrig").over(by_sub().rowsBetween(-2, 0)),
        "temp_mean_ontem": F.lag("temp_mean", 1).over(by_sub()),
    })


def densify(df: DataFrame) -> DataFrame:
    """Insert the missing days of each subsystem, so that row lags become calendar lags."""
    span = df.groupBy(SUB).agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi"))
    grid = span.select(SUB, F.explode(F.sequence("lo", "hi")).alias(DAY))
    return grid.join(df, [SUB, DAY], "left")
