"""Gradient boosted trees of all regions from sums of gradients by node, feature and bin.

Features become bin numbers (quantiles of each region's own rows), with one more bin for missing values, whose side a
split learns. Labels, gradients and leaf values are whole numbers of ``1 / UNIT``, so sums are exact in any order, and
the two ways of adding them up give the same trees to the last bit:

* ``fit_together``: every level of all regions' trees is one Spark aggregate over (region, node, feature, bin), with one
  partial sum a task. What reaches the driver is bounded by the settings: regions x nodes x features x bins.
* ``fit_apart``: regions with at most ``local_rows`` rows, counted beforehand, are one group each, and the same sums are
  taken inside it. Days of a calendar stay far below that bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.schema import SUB
from loadcast.session import written

UNIT = 1024
ROW, TARGET = "linha", "alvo"


@dataclass(frozen=True)
class Settings:
    """The boosting settings."""

    rounds: int = 600
    rate: float = 0.05
    depth: int = 5
    rows: float = 0.8
    columns: float = 0.8
    min_child: float = 5.0
    l2: float = 1.0
    seed: int = 42
    bins: int = 64
    local_rows: int = 200_000
    settle_rounds: int = 20

    @property
    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1


@dataclass
class Forest:
    """Trees as arrays (tree x node); node k has the children 2k + 1 and 2k + 2, a leaf has feature -1."""

    start: int
    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(start: int, trees: int, nodes: int) -> "Forest":
        shape = (trees, nodes)
        return Forest(start, np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.full(shape, np.nan),
                      np.zeros(shape, bool), np.zeros(shape), np.zeros(shape, np.int64))

    def walk(self, goes_left: Callable, n: int, first: int, stop: int, steps: int) -> np.ndarray:
        """The node that each of ``n`` rows reaches in trees ``first`` to ``stop`` after so many steps."""
        tree, row = np.arange(first, stop), np.arange(n)[:, None]
        at = np.zeros((n, stop - first), np.int64)
        for _ in range(steps):
            feature = self.feature[tree, at]
            left = goes_left(row, np.maximum(feature, 0), tree, at)
            at = np.where(feature >= 0, 2 * at + 2 - left, at)
        return at

    def by_bin(self, bins: np.ndarray, missing: int, first: int, stop: int, steps: int) -> np.ndarray:
        def goes_left(row, feature, tree, at):
            own = bins[row, feature]
            return np.where(own == missing, self.missing_left[tree, at], own <= self.bin[tree, at])
        return self.walk(goes_left, len(bins), first, stop, steps)

    def summed(self, at: np.ndarray, first: int, stop: int) -> np.ndarray:
        return self.value[np.arange(first, stop), at].sum(axis=1)

    def predict(self, inputs: np.ndarray) -> np.ndarray:
        """The response of rows of feature values; NaN is missing."""
        trees, nodes = self.feature.shape
        steps, out = (nodes + 1).bit_length() - 2, np.zeros(len(inputs))

        for begin in range(0, len(inputs), 1024):
            some = inputs[begin:begin + 1024]

            def goes_left(row, feature, tree, at):
                own = some[row, feature]
                return np.where(np.isnan(own), self.missing_left[tree, at], own <= self.threshold[tree, at])
            at = self.walk(goes_left, len(some), 0, trees, steps)
            out[begin:begin + 1024] = (self.start + self.summed(at, 0, trees)) / UNIT
        return out

    def importance(self, features: int) -> np.ndarray:
        """Share of the gain that each feature brings."""
        split = self.feature >= 0
        total = np.bincount(self.feature[split], self.gain[split], minlength=features)
        return total / total.sum() if total.sum() > 0 else np.full(features, 1 / features)


def drawn_rows(ids: np.ndarray, number: int, s: Settings) -> np.ndarray:
    """Which rows a round reads: a hash of the row and the round, whatever partition the row is in."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(number + 1 + s.seed) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) < np.uint64(int(s.rows * (1 << 53)))


def drawn_columns(features: int, number: int, s: Settings) -> np.ndarray:
    keep = np.zeros(features, bool)
    keep[np.random.default_rng([s.seed, number]).permutation(features)[:max(1, round(s.columns * features))]] = True
    return keep


def sums(bins: np.ndarray, gradient: np.ndarray, node: np.ndarray, nodes: int, s: Settings) -> np.ndarray:
    """(2, node, feature, bin): gradients and rows; the last bin is that of missing values."""
    shape = (nodes, bins.shape[1], s.bins + 1)
    keys = ((node[:, None] * shape[1] + np.arange(shape[1])) * shape[2] + bins).ravel()
    total = np.bincount(keys, np.repeat(gradient, shape[1]), minlength=int(np.prod(shape)))
    return np.stack([total, np.bincount(keys, minlength=int(np.prod(shape)))]).reshape(2, *shape)


def best_splits(total: np.ndarray, allowed: np.ndarray, s: Settings):
    """For every node its best gain, feature, bin, side of missing values, and the sums of its left side."""
    drawn = np.flatnonzero(allowed)
    some = total[:, :, drawn]
    whole = some[:, :, 0].sum(axis=-1)
    left = np.cumsum(some[..., :-1], axis=-1)[:, :, :, None]         # node, feature, side, bin
    if some[1, ..., -1].any():                                      # else both sides are the same
        left = np.concatenate([left, left + some[:, :, :, None, -1:]], axis=3)
    over = whole[:, :, None, None, None] - left
    gain = left[0] ** 2 / (left[1] + s.l2) + over[0] ** 2 / (over[1] + s.l2)
    gain[(left[1] < s.min_child) | (over[1] < s.min_child)] = -np.inf
    flat, node = gain.reshape(len(gain), -1), np.arange(len(gain))
    best = flat.argmax(axis=1)
    feature, side, cut = np.unravel_index(best, gain.shape[1:])
    return (flat[node, best] - whole[0] ** 2 / (whole[1] + s.l2), drawn[feature], cut, side.astype(bool),
            left[:, node, feature, side, cut], whole)


def leaf(total: np.ndarray, s: Settings) -> np.ndarray:
    return np.rint(-s.rate * total[0] / (total[1] + s.l2)).astype(np.int64)


def grow(forest: Forest, number: int, depth: int, total: np.ndarray, edges: list[np.ndarray], s: Settings) -> None:
    """One more level of tree ``number``, from the sums of the nodes of that depth."""
    gain, feature, cut, side, left, whole = best_splits(total, drawn_columns(total.shape[2], number, s), s)
    first = 2 ** depth - 1
    forest.value[number, first:first + len(gain)] = leaf(whole, s)
    chosen = np.flatnonzero(gain > 0)
    at = first + chosen
    forest.feature[number, at], forest.bin[number, at] = feature[chosen], cut[chosen]
    forest.missing_left[number, at], forest.gain[number, at] = side[chosen], gain[chosen] / UNIT ** 2
    forest.threshold[number, at] = [edges[f][b] if b < len(edges[f]) else np.inf
                                    for f, b in zip(feature[chosen].tolist(), cut[chosen].tolist())]
    if depth + 1 == s.depth:
        forest.value[number, 2 * at + 1] = leaf(left[:, chosen], s)
        forest.value[number, 2 * at + 2] = leaf((whole - left)[:, chosen], s)


def binned(values: np.ndarray, edges: list[np.ndarray], s: Settings) -> np.ndarray:
    """Bin b holds the values above edge b - 1, up to edge b."""
    out = np.empty(values.shape, np.int32)
    for f, own in enumerate(edges):
        out[:, f] = np.where(np.isnan(values[:, f]), s.bins, np.searchsorted(own, values[:, f], side="left"))
    return out


def level_of_rows(forest, bins, ids, target, predicted, number, depth, s):
    """Bins, gradients and nodes of the drawn rows that stand on a level of tree ``number``."""
    node = forest.by_bin(bins, s.bins, number, number + 1, depth)[:, 0] - (2 ** depth - 1)
    here = (node >= 0) & drawn_rows(ids, number, s)
    return bins[here], (predicted - target)[here], node[here]


def fit_rows(bins: np.ndarray, ids: np.ndarray, target: np.ndarray, edges: list[np.ndarray], s: Settings) -> Forest:
    """One region, all of whose rows are here."""
    forest = Forest.empty(int(target.sum()) // len(target), s.rounds, s.nodes)
    predicted = np.full(len(target), forest.start)
    for number in range(s.rounds):
        for depth in range(s.depth):
            grow(forest, number, depth, sums(*level_of_rows(forest, bins, ids, target, predicted, number, depth, s),
                                             2 ** depth, s), edges, s)
        predicted = predicted + forest.summed(forest.by_bin(bins, s.bins, number, number + 1, s.depth), number, number + 1)
    return forest


def feature_edges(rows: DataFrame, features: list[str], s: Settings):
    """Row count, sum of targets and bin edges of every region, from one aggregate over all rows."""
    shares = F.array(*[F.lit(k / s.bins) for k in range(1, s.bins)])
    found = rows.groupBy(SUB).agg(F.count(F.lit(1)), F.sum(TARGET), *[
        F.percentile_approx(F.col(f).cast("double"), shares, 10_000) for f in features]).collect()
    return {r[0]: (r[1], r[2], [np.unique(np.array(e or [], float)) for e in r[3:]]) for r in found}


def values_of(batch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch[f].to_numpy(dtype=float, na_value=np.nan) for f in features])


FOREST = (f"{SUB} string, arvore int, inicio long, atributo array<int>, faixa array<int>, limite array<double>, "
          "ausente_esquerda array<boolean>, ganho array<double>, valor array<long>")


def forest_rows(region: str, forest: Forest) -> list[tuple]:
    arrays = (forest.feature, forest.bin, forest.threshold, forest.missing_left, forest.gain, forest.value)
    return [(region, t, forest.start, *(a[t].tolist() for a in arrays)) for t in range(len(forest.feature))]


def forests_of(rows) -> dict[str, Forest]:
    """Rows of ``FOREST``; their number is bounded by the settings."""
    by_region: dict[str, list] = {}
    for r in rows:
        by_region.setdefault(r[0], []).append(r)
    kinds = (np.int32, np.int32, float, bool, float, np.int64)
    return {region: Forest(own[0][2], *(np.array([r[3 + k] for r in sorted(own, key=lambda r: r[1])], kind)
                                        for k, kind in enumerate(kinds))) for region, own in by_region.items()}


def fit_apart(rows: DataFrame, features: list[str], edges: dict, s: Settings) -> dict[str, Forest]:
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        region = group[SUB].iloc[0]
        own = edges[region][2]
        forest = fit_rows(binned(values_of(group, features), own, s), group[ROW].to_numpy(), group[TARGET].to_numpy(), own, s)
        return pd.DataFrame(forest_rows(region, forest), columns=[c.split()[0] for c in FOREST.split(", ")])

    # a number that is asked for is kept by adaptive execution, which would else put all small groups in one task
    spread = rows.repartition(16 * len(edges), SUB)
    return forests_of(spread.groupBy(SUB).applyInPandas(fit, FOREST).collect())


BLOCK = f"{SUB} string, faixas binary, linhas binary, alvos binary, previstos binary"


def fit_together(rows: DataFrame, features: list[str], edges: dict, s: Settings) -> dict[str, Forest]:
    """Level by level over all regions: one aggregate each, whatever the number of rows."""
    forests = {r: Forest.empty(total // n, s.rounds, s.nodes) for r, (n, total, _) in edges.items()}
    columns = [c.split()[0] for c in BLOCK.split(", ")]

    def blocks_of(batches):
        for batch in batches:
            for region, group in batch.groupby(SUB):
                bins = binned(values_of(group, features), edges[region][2], s).astype("<i2")
                start = np.full(len(group), forests[region].start, np.int64)
                yield pd.DataFrame([(region, bins.tobytes(), group[ROW].to_numpy().tobytes(),
                                     group[TARGET].to_numpy().tobytes(), start.tobytes())], columns=columns)

    def unpacked(batch):
        for region, bins, ids, target, predicted in zip(*(batch.column(c).to_pylist() for c in columns)):
            yield (region, np.frombuffer(bins, "<i2").astype(np.int32).reshape(-1, len(features)),
                   np.frombuffer(ids, np.int64), np.frombuffer(target, np.int64), np.frombuffer(predicted, np.int64))

    blocks, settled = written(rows.mapInPandas(blocks_of, BLOCK)), 0

    def caught_up(own, bins, predicted, done, number):
        if number == done:
            return predicted
        return predicted + own.summed(own.by_bin(bins, s.bins, done, number, s.depth), done, number)

    for number in range(s.rounds):
        recent = {r: replace(f, **{k: getattr(f, k)[settled:number + 1] for k in (
            "feature", "bin", "threshold", "missing_left", "gain", "value")}) for r, f in forests.items()}
        for depth in range(s.depth):
            def level(batches, number=number - settled, depth=depth, recent=recent, round_no=number):
                found: dict[str, np.ndarray] = {}
                for batch in batches:
                    for region, bins, ids, target, predicted in unpacked(batch):
                        own = recent[region]
                        now = caught_up(own, bins, predicted, 0, number)
                        node = own.by_bin(bins, s.bins, number, number + 1, depth)[:, 0] - (2 ** depth - 1)
                        here = (node >= 0) & drawn_rows(ids, round_no, s)
                        part = sums(bins[here], (now - target)[here], node[here], 2 ** depth, s)
                        found[region] = found[region] + part if region in found else part
                for region, part in found.items():
                    flat = part.reshape(2, -1)
                    at = np.flatnonzero(flat[1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([region] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(flat[0, at].astype(np.int64)),
                        pa.array(flat[1, at].astype(np.int64))], names=[SUB, "lugar", "gradiente", "n"])

            added = (blocks.mapInArrow(level, f"{SUB} string, lugar int, gradiente long, n long")
                     .groupBy(SUB, "lugar").agg(F.sum("gradiente").alias("gradiente"), F.sum("n").alias("n")).toPandas())
            shape = (2, 2 ** depth, len(features), s.bins + 1)
            for region, forest in forests.items():
                own, total = added[added[SUB] == region], np.zeros(shape)
                total.reshape(2, -1)[:, own["lugar"].to_numpy()] = own[["gradiente", "n"]].to_numpy().T
                grow(forest, number, depth, total, edges[region][2], s)
        if number + 1 - settled == s.settle_rounds:
            def settle(batches, number=number + 1 - settled, recent=recent):
                for batch in batches:
                    for k, (region, bins, _, _, predicted) in enumerate(unpacked(batch)):
                        now = caught_up(recent[region], bins, predicted, 0, number)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in columns[:-1]),
                                                          pa.array([now.tobytes()], pa.binary())], names=columns)
            blocks, settled = written(blocks.mapInArrow(settle, BLOCK)), number + 1
    return forests


def fit_forests(rows: DataFrame, features: list[str], s: Settings) -> dict[str, Forest]:
    """``rows``: region, ``ROW`` (a long that tells rows apart), ``TARGET`` (a whole number of ``1 / UNIT``), features."""
    edges = feature_edges(rows, features, s)
    small = max((n for n, _, _ in edges.values()), default=0) <= s.local_rows
    return (fit_apart if small else fit_together)(rows, features, edges, s) if edges else {}
