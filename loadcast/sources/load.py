"""Daily load files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.text import user_date
from loadcast.schema import DAY, LOAD_SCHEMA, SUB, SUBSYSTEMS


def read_load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Semicolon-separated load files, one per year, with known subsystems only.

    The schema is given, so no file is read twice; unknown subsystems are filtered in the scan.
    """
    rows = spark.read.csv(paths, sep=";", header=True, schema=LOAD_SCHEMA, enforceSchema=False)
    return rows.filter(F.col(SUB).isin(SUBSYSTEMS)).withColumn(DAY, user_date(F.col(DAY)))
