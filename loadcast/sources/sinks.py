"""Tables and text files written by the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.functions.text import decimal_comma
from loadcast.session import settle

YEAR = "ano"


def write_by_year(df: DataFrame, path: str) -> None:
    """Parquet partitioned by year; only the years present in the data are replaced."""
    (df.repartition(YEAR).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(YEAR).parquet(path))


def read_by_year(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if years is None else df.filter(F.col(YEAR).isin(years))


MANIFEST = f"{YEAR} int, path string, length long, modificationTime timestamp"


def manifest(spark: SparkSession, folders: dict[int, str], glob: str) -> DataFrame:
    """Path, length and time of every input file of each year; contents are not read."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true"))
    parts = [listing.load(folder).select(F.lit(year).alias(YEAR), "path", "length", "modificationTime")
             for year, folder in folders.items()]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], MANIFEST))


def changed_years(old: DataFrame, new: DataFrame) -> list[int]:
    """Years with a file that is new, gone, or of another length or time; at most one value a year reaches the driver."""
    before = old.select(YEAR, "path", "length", "modificationTime", F.lit(True).alias("antes"))
    after = new.select(YEAR, "path", "length", "modificationTime", F.lit(True).alias("depois"))
    joined = before.join(after, [YEAR, "path", "length", "modificationTime"], "full_outer")
    changed = joined.filter(F.col("antes").isNull() | F.col("depois").isNull())
    return sorted(r[0] for r in changed.select(YEAR).distinct().collect())


def cached_years(spark: SparkSession, path: str, folders: dict[int, str], glob: str,
                 build: Callable[[int], DataFrame], use_cache: bool = True) -> list[int]:
    """Builds the years whose input files are not those that they were last built from; returns these years.

    The manifest is written after the rows, so a build that fails is done again.
    """
    written = f"{path}/_manifest"
    now = settle(manifest(spark, folders, glob))
    try:
        old = spark.read.schema(MANIFEST).parquet(written).filter(F.col(YEAR).isin(list(folders)))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], MANIFEST)
    years = changed_years(old, now) if use_cache else sorted(folders)
    for year in years:
        build(year).write.mode("overwrite").parquet(f"{path}/{YEAR}={year}")
    if years:
        (now.filter(F.col(YEAR).isin(years)).repartition(YEAR).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(YEAR).parquet(written))
    return years


POINTER = "versao string, numero long"


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Result tables published together: a new folder for all of them, and one pointer row that is committed last.

    Readers follow the pointer with the greatest number, so they see all tables of one job, and a job that fails leaves the
    version before it.
    """
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/{version}/{name}")
    number = (published_version(spark, root) or (None, 0))[1] + 1
    (spark.createDataFrame([(version, number)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointer"))
    return version


def published_version(spark: SparkSession, root: str) -> tuple[str, int] | None:
    try:
        found = spark.read.schema(POINTER).parquet(f"{root}/pointer")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return tuple(found.agg(F.max_by("versao", "numero"), F.max("numero")).first())


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = published_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{version[0]}/{name}")


def brazilian_text(df: DataFrame) -> DataFrame:
    """All fractional columns as text with a decimal comma."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(*[decimal_comma(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, fractional) else F.col(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, brazilian: bool = False) -> None:
    """UTF-8 CSV; the Brazilian form has semicolons and decimal commas."""
    if brazilian:
        brazilian_text(df).write.mode("overwrite").csv(path, header=True, sep=";")
    else:
        df.write.mode("overwrite").csv(path, header=True)
