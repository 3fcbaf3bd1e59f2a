"""Forecast metrics, baselines and gain over the best fair baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.text import lookup
from loadcast.operators.series import fill_both_ways
from loadcast.schema import (BASELINE_CLASS, BASELINE_PREFIX, DAY, LOAD, MODE_CLASS, NATIONAL, SUB,
                             SUBSYSTEMS)

PRED = "previsao"
MODE = "modo"


def metric_columns(actual: Column, predicted: Column) -> list[Column]:
    """MAE, RMSE, MAPE %, R2 and n over the pairs where both sides are present."""
    both = actual.isNotNull() & predicted.isNotNull() & ~F.isnan(actual) & ~F.isnan(predicted)
    y = F.when(both, actual)
    error = F.when(both, predicted - actual)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, y))) * 100).alias("mape"),
        (1 - F.try_divide(F.sum(error * error), F.regr_syy(y, y))).alias("r2"),
        F.count(error).alias("n"),
    ]


def forecast_metrics(rows: DataFrame, keys: list[str], actual: str = LOAD,
                     predicted: str = PRED) -> DataFrame:
    return rows.groupBy(*keys).agg(*metric_columns(F.col(actual), F.col(predicted)))


def baseline_table(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows with the four baselines as columns, for all regions at once."""
    mean = train.groupBy(SUB).agg(F.avg(LOAD).alias("media_treino"))
    profile = (train.groupBy(SUB, F.dayofyear(DAY).alias("dia_ano"))
               .agg(F.avg(LOAD).alias("perfil")))
    return (test.select(SUB, DAY, LOAD, F.dayofyear(DAY).alias("dia_ano"),
                        F.col("carga_ontem").alias("persistencia"),
                        F.col("carga_lag7").alias("semana_anterior"))
            .join(mean, SUB, "left")
            .join(profile, [SUB, "dia_ano"], "left")
            .withColumn("climatologia", fill_both_ways(F.col("perfil")))
            .drop("dia_ano", "perfil"))


def baseline_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    """Long form (region, day, load, mode, prediction). A lag baseline without any value is absent."""
    names = list(BASELINE_CLASS)
    wide = baseline_table(train, test)
    return (wide.unpivot([SUB, DAY, LOAD], names, MODE, PRED)
            .filter(F.col(PRED).isNotNull() | F.col(MODE).isin("media_treino", "climatologia"))
            .withColumn(MODE, F.concat(F.lit(BASELINE_PREFIX), MODE)))


def information_class(mode: Column) -> Column:
    names = {**{BASELINE_PREFIX + k: v for k, v in BASELINE_CLASS.items()}, **MODE_CLASS}
    return lookup(names, mode)


def class_gain(metrics: DataFrame) -> DataFrame:
    """Gain in percent over the best baseline that may read the same information."""
    is_baseline = F.col(MODE).startswith(BASELINE_PREFIX)
    same = Window.partitionBy(SUB, "classe")       # one row per mode
    best = F.min(F.when(is_baseline, F.col("mae"))).over(same)
    gain = F.when(~is_baseline, (1 - F.try_divide(F.col("mae"), best)) * 100)
    return metrics.withColumn("classe", information_class(F.col(MODE))).withColumn("ganho_pct", gain)


def bottom_up(predictions: DataFrame, mode: str) -> DataFrame:
    """Sum of the four subsystem predictions against national load, on complete days.

    One aggregate over all rows: the national observation is picked out of the same group.
    """
    part = F.col(SUB).isin(SUBSYSTEMS)
    return (predictions.groupBy(DAY)
            .agg(F.countDistinct(F.when(part, F.col(SUB))).alias("n_subs"),
                 F.sum(F.when(part, F.col(PRED))).alias(PRED),
                 F.max(F.when(F.col(SUB) == NATIONAL, F.col(LOAD))).alias(LOAD))
            .filter(F.col("n_subs") == len(SUBSYSTEMS))
            .select(F.lit(NATIONAL).alias(SUB), DAY, LOAD,
                    F.lit(f"{mode} (soma dos 4)").alias(MODE), PRED))


def error_series(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("erro", F.col(PRED) - F.col(LOAD))


def accuracy_pivot(metrics: DataFrame, modes: list[str]) -> DataFrame:
    """Region x mode accuracy, 100 - MAPE; baselines left out."""
    rows = metrics.filter(~F.col(MODE).startswith(BASELINE_PREFIX))
    return rows.groupBy(SUB).pivot(MODE, modes).agg(F.avg(100 - F.col("mape")))
