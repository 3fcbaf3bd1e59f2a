"""Score sheet: baselines, model modes and bottom-up sums in one long table, scored once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.models.trees import Package
from loadcast.operators.metrics import (MODE, PRED, baseline_predictions, bottom_up, class_gain,
                                        forecast_metrics)
from loadcast.operators.recursive import recursive_forecast
from loadcast.schema import DAY, LOAD, SUB


def by_mode(predictions: DataFrame, mode: str) -> DataFrame:
    return predictions.select(SUB, DAY, LOAD, F.lit(mode).alias(MODE), PRED)


def recursive_with_trees(package: Package, test: DataFrame, scenario: list[str] | None = None) -> DataFrame:
    """Recursive forecast of the delta model, of every scenario; its trees travel to the tasks as flat arrays."""
    names, mode = package.features, package.mode
    shared = test.sparkSession.sparkContext.broadcast(package.trees)        # rounds x nodes x regions, fixed by settings

    def step(region, row):
        if region not in shared.value:
            raise ValueError(f"no fitted model for region {region} in {mode}")
        return row["carga_ontem"] + shared.value[region].predict(np.column_stack([row[n] for n in names]))

    return recursive_forecast(test, names, step, scenario=scenario)


def score(predictions: DataFrame, summed_modes: list[str]) -> DataFrame:
    """Metrics and class gain of a long prediction table, with bottom-up rows for some modes."""
    rows = predictions
    for mode in summed_modes:
        rows = rows.unionByName(bottom_up(predictions.filter(F.col(MODE) == mode), mode)
                                .select(*predictions.columns))
    return class_gain(forecast_metrics(rows, [SUB, MODE]))


def score_sheet(train: DataFrame, test: DataFrame, modes: dict[str, DataFrame]) -> DataFrame:
    """Baselines plus the given modes' predictions (columns region, day, load, prediction)."""
    long = baseline_predictions(train, test)
    for mode, predictions in modes.items():
        long = long.unionByName(by_mode(predictions, mode))
    summed = [m for m in ("climatico", "delta_recursivo") if m in modes]
    return score(long, summed)
