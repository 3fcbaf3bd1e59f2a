"""Centroid clustering by a VA-file.

Every vector becomes whole numbers, ``floor(scale * x)``, and an approximation of four bits a dimension: the number of
the cell that its component lies in, two dimensions to a byte. Cell borders are quantiles of a bounded sample
(``SAMPLE`` vectors, those with the smallest hash); the outer cells end at the exact smallest and largest component of
all vectors. For each round, lookup tables give the least and the greatest squared distance from every pair of cells to
every centroid, and their sums bound the distance of a vector from below and above. Where one centroid's interval lies
below all others, the vector is assigned by its cells alone; only where intervals overlap its components are
fetched and compared with the centroids left over, exactly. The sums that move a centroid need every component once more,
so approximation and components are columns of one table and nothing is shuffled but one partial sum for each task,
centroid and dimension.

Defined cases: vectors null, of another length, or with a null or non-finite component take no part, nor do vectors with
a component beyond 2**27 / scale, whose squared distances a long does not hold. Repeated rows are vectors each. First
centroids are the vectors with the smallest hash of ``1:<vec_id>``, equal ones ordered by components, a null id last; with
fewer vectors than centroids there are fewer centroids. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

CELLS = 16
SAMPLE = 4096
LARGEST = 1 << 27
ROWS = 4096


def whole_vectors(df: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, parts): the vectors that take part, as whole numbers."""
    bound = LARGEST / scale
    fine = (F.size("embedding") == dimensions) & F.forall(
        "embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < bound, F.lit(False)))
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return df.where(F.coalesce(fine, F.lit(False))).select("vec_id", parts.alias("parts"))


def matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


@dataclass(frozen=True)
class Cells:
    """Borders of the cells of every dimension: cell j of dimension d holds ``low[d, j]`` to ``high[d, j]``."""

    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> "Cells":
        ordered = np.sort(sample, axis=0)
        inner = ordered[np.arange(1, CELLS) * len(sample) // CELLS].T
        return Cells(np.column_stack([least, inner]), np.column_stack([inner - 1, greatest]))

    def approximate(self, vectors: np.ndarray) -> np.ndarray:
        """Two cells to a byte; an odd last dimension is paired with nothing."""
        codes = np.empty((len(vectors), len(self.low) + len(self.low) % 2), np.uint8)
        codes[:, -1] = 0
        for d in range(len(self.low)):
            codes[:, d] = np.searchsorted(self.low[d, 1:], vectors[:, d], side="right")
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """(byte, value, centroid) sums of the least and, behind them, the greatest squared distances."""
        apart = np.maximum(np.maximum(self.low[:, :, None] - centroids.T[:, None], centroids.T[:, None]
                                      - self.high[:, :, None]), 0) ** 2
        across = np.maximum(np.abs(self.low[:, :, None] - centroids.T[:, None]),
                            np.abs(self.high[:, :, None] - centroids.T[:, None])) ** 2
        both = np.concatenate([apart, across], axis=2)
        if len(both) % 2:
            both = np.concatenate([both, np.zeros_like(both[:1])])
        return (both[0::2, :, None] + both[1::2, None]).reshape(len(both) // 2, CELLS * CELLS, -1)


def nearest(cells: np.ndarray, vectors: np.ndarray, centroids: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each vector, the smallest among equal ones."""
    bounds = np.zeros((len(cells), tables.shape[2]), np.int64)
    for byte, table in enumerate(tables):
        bounds += table[cells[:, byte]]
    lower, upper = bounds[:, :len(centroids)], bounds[:, len(centroids):]
    possible = lower <= upper.min(axis=1)[:, None]
    found = possible.argmax(axis=1)
    overlap = np.flatnonzero(possible.sum(axis=1) > 1)
    row, centroid = np.nonzero(possible[overlap])
    exact = np.full((len(overlap), len(centroids)), np.iinfo(np.int64).max)
    exact[row, centroid] = ((vectors[overlap[row]] - centroids[centroid]) ** 2).sum(axis=1)
    found[overlap] = exact.argmin(axis=1)
    return found


def approximations(batch: pa.RecordBatch, dimensions: int):
    """Parts of a batch: cells, components, ids."""
    for begin in range(0, batch.num_rows, ROWS):
        some = batch.slice(begin, ROWS)
        cells = np.frombuffer(b"".join(some.column("cells").to_pylist()), np.uint8)
        yield cells.reshape(some.num_rows, -1), matrix(some, dimensions), some.column("vec_id")


def ranges(vectors: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest component of every dimension, over all vectors."""
    def extremes(batches):
        least = greatest = None
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch, dimensions)
                least = own.min(0) if least is None else np.minimum(least, own.min(0))
                greatest = own.max(0) if greatest is None else np.maximum(greatest, own.max(0))
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array(least, pa.int64()),
                                              pa.array(greatest, pa.int64())], names=["d", "least", "greatest"])

    found = (vectors.select("parts").mapInArrow(extremes, "d int, least long, greatest long")
             .groupBy("d").agg(F.min("least"), F.max("greatest")).orderBy("d").collect())     # a row a dimension
    return np.array([r[1] for r in found], np.int64), np.array([r[2] for r in found], np.int64)


def approximated(vectors: DataFrame, cells: Cells, dimensions: int) -> DataFrame:
    """The VA-file: every vector with the numbers of its cells."""
    def add_cells(batches):
        for batch in batches:
            codes = cells.approximate(matrix(batch, dimensions))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()),
                                              batch.column("parts")], names=["vec_id", "cells", "parts"])

    return vectors.mapInArrow(add_cells, "vec_id long, cells binary, parts array<int>")


def moved(va_file: DataFrame, cells: Cells, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the exact mean; an empty one stays."""
    count, dimensions = centroids.shape

    def sums(batches):
        tables = cells.tables(centroids)
        total, n = np.zeros((count, dimensions), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for codes, vectors, _ in approximations(batch, dimensions):
                cluster = nearest(codes, vectors, centroids, tables)
                np.add.at(total, cluster, vectors)
                n += np.bincount(cluster, minlength=count)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()),
                                          pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "total"])

    partial = va_file.mapInArrow(sums, "cluster int, n long, total array<long>")
    found = (partial.select("cluster", "n", F.posexplode("total").alias("d", "total"))
             .groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    new = centroids.copy()
    for r in found:                                  # centroids x dimensions
        new[r.cluster, r.d] = r.total // r.n
    return new


def assigned(va_file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def assign(batches):
        tables = cells.tables(centroids)
        for batch in batches:
            for codes, vectors, ids in approximations(batch, centroids.shape[1]):
                cluster = nearest(codes, vectors, centroids, tables)
                distance = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    return va_file.mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, centroids: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64,
            seed: str = "1:", sample: int = SAMPLE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    The driver holds ``sample`` vectors for the cell borders and the first centroids, and one sum for each centroid
    and dimension, whatever the table's size.
    """
    spark, shape = df.sparkSession, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, " \
                                    "centroid_sha256 string"
    vectors = whole_vectors(df, dimensions, scale)
    smallest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = (vectors.orderBy(smallest.asc_nulls_last(), "parts").limit(max(sample, centroids))
             .select("parts").collect())             # bounded by the parameter
    if not first:
        return spark.createDataFrame([], shape)
    drawn = np.array([r.parts for r in first], np.int64)
    cells = Cells.of(drawn, *ranges(vectors, dimensions))
    va_file = stage(approximated(vectors, cells, dimensions), "va-file")
    centres = drawn[:centroids]
    for _ in range(rounds):
        centres = moved(va_file, cells, centres)
    found = stage(assigned(va_file, cells, centres), "clusters")
    inertia = {r.cluster: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}   # a row a cluster
    about = [(k, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[k].tolist())).encode())
              .hexdigest()) for k in sorted(inertia)]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in shape.split(", ")])
