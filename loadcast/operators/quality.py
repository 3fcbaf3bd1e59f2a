"""Quality control of sensor readings and duplicate handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.schema import SENSOR_LIMITS


def within_limits(value: Column, low: float, high: float) -> Column:
    """The value if it is inside the inclusive bounds, else null. NaN counts as missing."""
    return F.when(~F.isnan(value) & value.between(low, high), value)


def quality_control(readings: DataFrame, limits: dict = SENSOR_LIMITS) -> DataFrame:
    """Null every reading outside its physical limits."""
    return readings.withColumns({
        sensor: within_limits(F.col(sensor), low, high)
        for sensor, (low, high) in limits.items() if sensor in readings.columns
    })


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that comes last in the given order.

    Written as an aggregate, not as a ranking window, so duplicates collapse on the map side and
    a key with very many copies never reaches a single task whole. Spark sorts for it, as its buffer is a struct.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    chosen = F.max_by(F.struct(*rest), F.struct(*order)).alias("_kept")
    kept = df.groupBy(*keys).agg(chosen)
    return kept.select(*[F.col(c) if c in keys else F.col("_kept")[c].alias(c)
                         for c in df.columns])
