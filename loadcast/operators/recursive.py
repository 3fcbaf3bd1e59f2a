"""Recursive forecast: each day is predicted from the model's own earlier output."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcast.operators.metrics import PRED
from loadcast.schema import AUTOREGRESSIVE, DAY, LOAD, SEED_DAYS, SUB

# region code, features of one day of many series (name -> values) -> their forecasts
StepPredictor = Callable[[str, dict[str, np.ndarray]], np.ndarray]

POSITION, SEED, SLICE = "posicao", "semente", "fatia"
ROWS_PER_SLICE = 100_000


def seed_only(test: DataFrame, seed_days: int = SEED_DAYS, keys: list[str] | None = None) -> DataFrame:
    """Hide every observed load after the seed, so no later load can reach the forecast."""
    position = F.row_number().over(Window.partitionBy(*(keys or [SUB])).orderBy(DAY))
    return (test.withColumn(POSITION, position)
            .withColumn(SEED, F.when(F.col(POSITION) <= seed_days, F.col(LOAD)))
            .drop(LOAD, *AUTOREGRESSIVE))


def fold(step: StepPredictor, region: str, position: np.ndarray, loads: np.ndarray, inputs: dict[str, np.ndarray],
         seed_days: int) -> None:
    """Writes the forecasts of many series into ``loads``, one day of all of them at a time.

    Rows come in order of position, so a day is one slice. The state is the last seven loads of every series, as a ring of
    columns; a series that has ended is not in the slice any more, and its column is not written again.
    """
    # the longest series come first within a position, so those still running are always the first ones
    starts = np.searchsorted(position, np.arange(1, position[-1] + 2))
    week = np.empty((7, starts[1] - starts[0]))
    for day in range(len(starts) - 1):
        here = slice(starts[day], starts[day + 1])
        running = here.stop - here.start
        if day >= seed_days:
            state = week[:, :running]
            # oldest first, as a mean is summed in this order
            ordered = np.ascontiguousarray(state[np.arange(day, day + 7) % 7].T)
            row = {name: values[here] for name, values in inputs.items()}
            row.update(carga_ontem=ordered[:, -1], carga_lag7=ordered[:, 0], media_7d=ordered.mean(axis=1))
            loads[here] = step(region, row)
        week[day % 7, :running] = loads[here]


def recursive_forecast(test: DataFrame, features: list[str], step: StepPredictor, seed_days: int = SEED_DAYS,
                       scenario: list[str] | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Forecast a period from a seed of observed days, one independent series per region and scenario.

    A series is sequential by nature; many are folded together, a day of all of them at a time. Series are hashed into slices
    of about ``rows_per_slice`` rows, one task each, so scenarios may be any number. Only the seed rows bring
    observed load into a task. A series with missing load in its seed is an error.
    """
    if seed_days < SEED_DAYS:
        raise ValueError(f"the seed needs at least {SEED_DAYS} days")
    keys = [SUB, *(scenario or [])]
    exogenous = [c for c in features if c not in AUTOREGRESSIVE]
    hidden = seed_only(test, seed_days, keys).select(*keys, DAY, POSITION, SEED, *exogenous)
    slices = max(1, -(-test.count() // rows_per_slice)) if scenario else 1
    sliced = hidden.withColumn(SLICE, F.pmod(F.xxhash64(*keys), F.lit(slices)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group["_dias"] = group.groupby(keys, dropna=False)[DAY].transform("size")
        group["_serie"] = group.groupby(keys, dropna=False, sort=False).ngroup()
        group = group.sort_values([POSITION, "_dias", "_serie"], ascending=[True, False, True], ignore_index=True)
        position, loads = group[POSITION].to_numpy(), group[SEED].to_numpy(dtype=float, na_value=np.nan)
        if np.isnan(loads[position <= seed_days]).any():
            raise ValueError("the seed has missing load")
        inputs = {c: group[c].to_numpy(dtype=float, na_value=np.nan) for c in exogenous}
        fold(step, group[SUB].iloc[0], position, loads, inputs, seed_days)
        return group[keys + [DAY]].assign(**{PRED: loads})

    schema = hidden.select(*keys, DAY, F.lit(0.0).alias(PRED)).schema
    # a number that is asked for is kept by adaptive execution, which would else put small slices into one task
    return sliced.repartition(5 * slices, SUB, SLICE).groupBy(SUB, SLICE).applyInPandas(run, schema)
