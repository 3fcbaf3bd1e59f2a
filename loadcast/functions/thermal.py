"""Temperature expressions. A missing temperature always gives a missing result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadcast.schema import COOLING_BASE, HEATING_BASE


def _present(value: Column, result: Column) -> Column:
    # greatest/least skip nulls, so missing input has to be guarded
    return F.when(value.isNotNull(), result)


def cooling_degrees(temp: Column, base: float = COOLING_BASE) -> Column:
    return _present(temp, F.greatest(F.lit(0.0), temp - base))


def heating_degrees(temp: Column, base: float = HEATING_BASE) -> Column:
    return _present(temp, F.greatest(F.lit(0.0), F.lit(base) - temp))


def coherent_max(t_max: Column, t_mean: Column) -> Column:
    return _present(t_max + t_mean, F.greatest(t_max, t_mean))


def coherent_min(t_min: Column, t_mean: Column) -> Column:
    return _present(t_min + t_mean, F.least(t_min, t_mean))


def hours_above(threshold: float, t_mean: Column, t_max: Column, t_min: Column) -> Column:
    """Hours of the day above a threshold when temperature follows one sine cycle."""
    amplitude = F.greatest((t_max - t_min) / 2, F.lit(0.01))
    crossing = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.lit(threshold) - t_mean) / amplitude))
    hours = (F.pi() - F.asin(crossing) * 2) * 24 / (F.pi() * 2)
    return _present(t_mean + t_max + t_min, hours)
