"""Level model: least squares of load on the industrial level, all regions in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.operators.metrics import PRED
from loadcast.operators.series import fill_both_ways
from loadcast.schema import LEVEL_INPUT, LOAD, SUB

LEVEL = "nivel_industrial"


def fill_level_input(df: DataFrame) -> DataFrame:
    """Missing industrial levels take the last, else the next, known one of the region."""
    return df.withColumn(LEVEL_INPUT, fill_both_ways(F.col(LEVEL_INPUT)))


def fit_level(train: DataFrame) -> DataFrame:
    """One row per region: slope and intercept. Without usable input the level is mean load."""
    return (fill_level_input(train).filter(F.col(LOAD).isNotNull()).groupBy(SUB)
            .agg(F.regr_slope(LOAD, LEVEL_INPUT).alias("s"),
                 F.regr_intercept(LOAD, LEVEL_INPUT).alias("i"),
                 F.avg(LOAD).alias("media_treino"), F.count(F.lit(1)).alias("n_dias"))
            .select(SUB, F.coalesce("s", F.lit(0.0)).alias("inclinacao"),
                    F.when(F.col("s").isNull(), F.col("media_treino"))
                    .otherwise(F.col("i")).alias("intercepto"), "media_treino", "n_dias"))


def apply_level(df: DataFrame, level: DataFrame) -> DataFrame:
    """Adds the level column; a row of a region without a fitted level is an error that names it.

    Missing inputs are the caller's to fill (``fill_level_input``); where a region has none at all, the
    level is its intercept.
    """
    value = F.col("intercepto") + F.col("inclinacao") * F.coalesce(LEVEL_INPUT, F.lit(0.0))
    unfitted = F.raise_error(F.concat(F.lit("no fitted level for region "), F.col(SUB))).cast("double")
    return (df.join(F.broadcast(level.select(SUB, "inclinacao", "intercepto")), SUB, "left")   # a row per region
            .withColumn(LEVEL, F.when(F.col("inclinacao").isNull(), unfitted).otherwise(value))
            .drop("inclinacao", "intercepto"))


def level_predictor(level: DataFrame):
    """The level alone as a forecast, for tests and baselines that need no trees.

    It fills missing inputs by a window over each region, so it is for rows by region and day.
    """
    def predict(df: DataFrame) -> DataFrame:
        return apply_level(fill_level_input(df), level).withColumnRenamed(LEVEL, PRED)
    return predict
