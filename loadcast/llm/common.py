"""What several of the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Characters that end a word: the space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{shared_folder(spark)}/loadcast-llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, safe from lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spare(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as no table's column needs."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
