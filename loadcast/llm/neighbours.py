"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a Hadamard transform; a vector's bucket is its
nearest signed axis. ``functions`` such axes form a key when there are many vectors, so that buckets keep their size.
Every vector is in one bucket of each table; a query also probes the next best buckets. In a bucket its
queries meet its vectors block by block, exact distances on the original vectors keep the best, and the
best of all buckets are ranked.

Equal vectors are one entry with their smallest ids, which is all that a ranking can show of them. A bucket
of over ``CROWD`` entries is split over several tasks. The number of probes is fitted on a bounded sample
against brute force. Queries that met fewer than ``k`` candidates are compared with all vectors, in blocks.

Defined cases: vectors that are null, empty, zero, or hold a null or a value that is not finite take no part, nor do
rows with a null id; vectors of different lengths never meet; a repeated row counts once; a query without any
candidate has no rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TABLES = 16
#: Recall on the sample that the number of probes must reach.
WANTED = 0.96
#: Entries and queries of the sample on which probes are fitted.
SAMPLE = (8192, 64)
#: Entries that a key should hold; more entries get keys of more axes.
FILL = 2048
CROWD = 4096
BLOCK = 1024


def _padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotations(dim: int, tables: int, functions: int, seed: int) -> np.ndarray:
    """Random signs: (tables, functions, 3, padded dimension)."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1.0, 1.0]), (tables, functions, 3, _padded(dim)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, without scaling."""
    width = 1
    while width < x.shape[1]:
        x = x.reshape(len(x), -1, 2, width)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), -1)
        width *= 2
    return x


def rotate(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    x = np.zeros((len(vectors), signs.shape[1]))
    x[:, :vectors.shape[1]] = vectors / np.where(norms == 0, 1, norms)
    for flip in signs:
        x = hadamard(x * flip) / np.sqrt(signs.shape[1])
    return x


def axes(rotated: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes, nearest first, and how much farther each is than the first."""
    signed = np.concatenate([rotated, -rotated], axis=1)
    number = min(number, signed.shape[1])
    best = np.argpartition(-signed, number - 1, axis=1)[:, :number]
    values = np.take_along_axis(signed, best, 1)
    order = np.argsort(-values, axis=1, kind="stable")
    best, values = np.take_along_axis(best, order, 1), np.take_along_axis(values, order, 1)
    return best, values[:, :1] - values


def keys(vectors: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """Keys of one table, nearest first: (rows, up to ``probes``)."""
    functions, width = len(signs), 2 * signs.shape[2]
    found = [axes(rotate(vectors, s), probes if functions == 1 else int(np.ceil(probes ** 0.5)) + 2) for s in signs]
    key, cost = found[0][0].astype(np.int64), found[0][1] ** 2
    for axis, farther in found[1:]:
        pairs = list(product(range(key.shape[1]), range(axis.shape[1])))
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        key, cost = key[:, a] * width + axis[:, b], cost[:, a] + farther[:, b] ** 2
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        key, cost = np.take_along_axis(key, order, 1), np.take_along_axis(cost, order, 1)
    return key[:, :probes]


def fit_probes(sample: np.ndarray, queries: np.ndarray, k: int, signs: np.ndarray, wanted: float = WANTED) -> int:
    """About the fewest probes that find ``wanted`` of the true neighbours in the sample."""
    if not len(sample) or not len(queries):
        return 1
    true = np.argsort(np.stack([((sample - q) ** 2).sum(1) for q in queries]), axis=1)[:, :k + 1]
    most = (2 * signs.shape[3]) ** signs.shape[1]
    own = [keys(sample, s, 1)[:, 0] for s in signs]
    probes = 1
    while True:
        asked = [keys(queries, s, probes) for s in signs]
        met = np.zeros(true.shape, bool)
        for mine, theirs in zip(own, asked):
            met |= (mine[true][:, :, None] == theirs[:, None, :]).any(axis=2)
        if met.mean() >= wanted or probes >= most:
            return probes
        probes += max(1, probes // 4)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: ``entry`` (the smallest id), ``vector``, ``ids`` (the ``k + 1`` smallest)."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector")
                           ).where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = valid.withColumn("nth", rank).where(F.col("nth") <= k + 1)
    return few.groupBy("vector").agg(F.min("vec_id").alias("entry"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _spread(rows: DataFrame, signs_of, probes_of, column: str) -> DataFrame:
    """A row for each key: ``bucket`` holds the length, the table and the key."""

    def run(batches):
        for batch in batches:
            lengths = np.asarray(batch.column("vector").value_lengths())
            for dim in np.unique(lengths):
                own = batch.filter(pa.array(lengths == dim))
                for table, signs in enumerate(signs_of(int(dim))):
                    found = keys(_matrix(own.column("vector")), signs, probes_of(int(dim)))
                    for nth in range(found.shape[1]):
                        bucket = (np.int64(dim) << 48) + (np.int64(table) << 40) + found[:, nth]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket), own.column(column), own.column("vector")],
                            names=["bucket", column, "vector"])

    return rows.select(column, "vector").mapInArrow(run, f"bucket long, {column} long, vector {rows.schema['vector'].dataType.simpleString()}")


def _nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query its ``k`` nearest of a block: positions and distances, ties to the smaller id."""
    for q in queries:
        far = np.sqrt(((vectors - q) ** 2).sum(axis=1))
        some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
        some = some[np.lexsort((ids[some], far[some]))][:k]
        yield some, far[some]


def _compare(k: int):
    """Rows sorted by bucket, its queries first: each query's best entries of the bucket's blocks."""

    def flush(queries, held):
        if not queries or not held:
            return
        q_ids, q = zip(*queries)
        ids, vectors = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        out = [[], [], []]
        for query, (some, far) in zip(q_ids, _nearest(np.stack(q), vectors, ids, k)):
            out[0].append(np.full(len(some), query))
            out[1].append(ids[some])
            out[2].append(far)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out],
                                         names=["query", "entry", "score"])

    def run(batches):
        here, queries, held, size = None, [], [], 0
        for batch in batches:
            spot = np.stack([batch.column("bucket").to_numpy(), batch.column("salt").to_numpy()])
            cuts = np.flatnonzero((np.diff(spot) != 0).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                if here is None or (spot[:, begin] != here).any():
                    yield from flush(queries, held)
                    here, queries, held, size = spot[:, begin], [], [], 0
                own = batch.slice(begin, end - begin)
                ids, vectors = own.column("id").to_numpy(), _matrix(own.column("vector"))
                asked = own.column("is_entry").to_numpy(zero_copy_only=False) == 0
                queries += list(zip(ids[asked], vectors[asked]))
                if not asked.all():
                    held.append((ids[~asked], vectors[~asked]))
                    size += int((~asked).sum())
                if size >= CROWD:
                    yield from flush(queries, held)
                    held, size = [], 0
        yield from flush(queries, held)

    return run


def _exact(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The nearest of all entries for the queries in ``asked``, which come to the driver in blocks."""
    found = None
    last = None
    while True:
        block = (asked if last is None else asked.where(F.col("entry") > last)).orderBy("entry").limit(BLOCK).collect()
        if not block:
            return found
        last = block[-1].entry

        def run(batches, block=block):
            for batch in batches:
                ids = batch.column("entry").to_numpy()
                lengths = np.asarray(batch.column("vector").value_lengths())
                for row in block:
                    same = np.flatnonzero(lengths == len(row.vector))
                    if not len(same):
                        continue
                    vectors = _matrix(batch.column("vector").take(pa.array(same)))
                    some, far = next(_nearest(np.array([row.vector]), vectors, ids[same], k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row.entry)),
                                                      pa.array(ids[same][some]), pa.array(far)],
                                                     names=["query", "entry", "score"])

        part = known.select("entry", "vector").mapInArrow(run, "query long, entry long, score double")
        found = part if found is None else found.union(part)


def nearest(vectors: DataFrame, is_query, k: int = 10, tables: int = TABLES, wanted: float = WANTED,
            fill: int = FILL, seed: int = 17) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``vec_id, embedding``) that ``is_query`` picks.

    ``is_query`` is a function of the id's column.
    """
    known = stage(entries(vectors, k), "vector-entries")
    asked_ids = stage(_query_ids(vectors, known, is_query), "query-ids")
    queries = stage(known.join(asked_ids.select("entry").distinct(), "entry"), "vector-queries")
    sizes = {r.dim: r.n for r in known.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    sample = known.orderBy(F.xxhash64("entry")).limit(SAMPLE[0]).select("vector").collect()
    tried = queries.orderBy(F.xxhash64("entry")).limit(SAMPLE[1]).select("vector").collect()
    functions = {d: 1 + (n > fill * 2 * _padded(d)) + (n > fill * (2 * _padded(d)) ** 2) for d, n in sizes.items()}
    signs = {d: rotations(d, tables, functions[d], seed) for d in sizes}
    probes = {d: fit_probes(np.array([r.vector for r in sample if len(r.vector) == d]),
                            np.array([r.vector for r in tried if len(r.vector) == d]), k, signs[d], wanted)
              for d in sizes}

    index = _spread(known, signs.__getitem__, lambda d: 1, "entry").withColumnRenamed("entry", "id")
    asked = _spread(queries.select("entry", "vector"), signs.__getitem__, probes.__getitem__, "entry"
                    ).withColumnRenamed("entry", "id")
    crowds = stage(index.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(
        "bucket", F.ceil(F.col("n") / CROWD).alias("parts")), "crowded-buckets")
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(crowds, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("id"), parts))
    asked = asked.join(crowds, "bucket", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    columns = ["bucket", "salt", "is_entry", "id", "vector"]
    met = (index.withColumn("is_entry", F.lit(1)).select(columns)
           .union(asked.withColumn("is_entry", F.lit(0)).select(columns))
           .repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "is_entry")
           .mapInArrow(_compare(k + 1), "query long, entry long, score double").distinct())
    best = stage(_top(met, k + 1), "met-entries")

    ids = best.join(known.select("entry", "ids"), "entry")
    found = ids.groupBy("query").agg(F.sum(F.size("ids")).alias("found"))
    every = known.groupBy(F.size("vector").alias("dim")).agg(F.sum(F.size("ids")).alias("all"))
    short = queries.select("entry", "vector", F.size("vector").alias("dim")).join(every, "dim").join(
        found, F.col("entry") == F.col("query"), "left").where(
        F.coalesce("found", F.lit(0)) < F.least("all", F.lit(k + 1))).select("entry", "vector")
    short = stage(short, "short-queries")
    if not short.isEmpty():
        extra = _top(_exact(short, known, k + 1), k + 1)
        ids = best.join(short.select(F.col("entry").alias("query")), "query", "left_anti").union(extra).join(
            known.select("entry", "ids"), "entry")

    rows = ids.join(asked_ids.withColumnRenamed("entry", "query"), "query").select(
        "query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_ids(vectors: DataFrame, known: DataFrame, is_query) -> DataFrame:
    """``query_id, entry``: the entry of every query that takes part."""
    asked = vectors.where(is_query(F.col("vec_id"))).select(
        F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return asked.join(known.select("entry", "vector"), "vector").select("query_id", "entry").distinct()


def _top(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "entry")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")
