"""Hourly station readings to daily climate per subsystem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.text import lookup
from loadcast.functions.thermal import cooling_degrees, heating_degrees
from loadcast.operators.quality import keep_last
from loadcast.schema import (CLIMATE_DAILY, DAY, HOT_HOUR, MIN_READINGS, STATION,
                             STATION_REGION_TO_SUB, SUB)


def map_station_region(df: DataFrame, region_col: str = "regiao_estacao") -> DataFrame:
    """Station region code to subsystem; rows of unknown regions are dropped."""
    return (df.withColumn(SUB, lookup(STATION_REGION_TO_SUB, F.upper(F.trim(region_col))))
            .filter(F.col(SUB).isNotNull())
            .drop(region_col))


def station_day(readings: DataFrame, keys: list[str], min_readings: int = MIN_READINGS) -> DataFrame:
    """Daily statistics per station in one hash aggregate.

    Hot hours and coverage are further aggregates of the same pass, not joins. All buffers are
    plain numbers, so each map task folds a busy station into one row per day before the shuffle.
    """
    have = set(readings.columns)
    temp = F.col("temp")
    stats = [F.avg("temp").alias("temp_mean"), F.max("temp").alias("temp_max"),
             F.min("temp").alias("temp_min"), F.avg("umid").alias("umid_mean"),
             F.min("umid").alias("umid_min")]
    if "rad" in have:
        stats.append(F.coalesce(F.sum("rad"), F.lit(0.0)).alias("rad_sum"))
    if "vento" in have:
        stats.append(F.avg("vento").alias("vento_mean"))
    if "precip" in have:
        stats.append(F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip_sum"))
    stats += [F.count_if(temp > HOT_HOUR).cast("double").alias("horas_acima_26"),
              F.count("temp").alias("n_leituras")]
    # degree days belong to the station's own daily mean, before any regional averaging
    return (readings.groupBy(*keys, DAY).agg(*stats)
            .filter(F.col("n_leituras") >= min_readings)
            .drop("n_leituras")
            .withColumns({"graus_refrig": cooling_degrees(F.col("temp_mean")),
                          "graus_aquec": heating_degrees(F.col("temp_mean"))}))


def dedup_station_days(days: DataFrame, file_col: str = "arquivo") -> DataFrame:
    """A station counts once per day; the file that sorts last wins."""
    return keep_last(days, [STATION, DAY], [file_col])


def regional_climate(days: DataFrame) -> DataFrame:
    """Mean of every station statistic per day and subsystem, with the number of stations.

    Expects one row per station and day (see ``dedup_station_days``), so counting rows counts
    distinct stations.
    """
    present = [c for c in CLIMATE_DAILY if c in days.columns]
    return days.groupBy(DAY, SUB).agg(*[F.avg(c).alias(c) for c in present],
                                      F.count(STATION).cast("double").alias("n_estacoes"))
