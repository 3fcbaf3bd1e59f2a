"""Station files to regional climate: scan, quality control, station days, regional means, a table per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.operators.climate import (dedup_station_days, map_station_region, regional_climate,
                                        station_day)
from loadcast.operators.quality import quality_control
from loadcast.schema import STATION, SUB
from loadcast.sources.sinks import YEAR, cached_years, read_by_year
from loadcast.sources.stations import read_stations


def year_climate(spark: SparkSession, folder: str, glob: str = "*.CSV") -> DataFrame:
    """Regional climate of one folder of station files; of a station's files for a day the last one counts."""
    readings = map_station_region(quality_control(read_stations(spark, folder, glob)))
    return regional_climate(dedup_station_days(station_day(readings, ["arquivo", STATION, SUB])))


def climate_of_years(spark: SparkSession, folders: dict[int, str], cache: str, glob: str = "*.CSV",
                     use_cache: bool = True) -> DataFrame:
    """All years together. Only years whose files changed since they were written are computed again."""
    cached_years(spark, cache, folders, glob, lambda year: year_climate(spark, folders[year], glob), use_cache)
    return read_by_year(spark, cache, list(folders)).withColumn(YEAR, F.col(YEAR).cast("int"))
