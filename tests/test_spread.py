"""Positions, exact medians and carried values against plain Python."""

import math
import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from loadcast.operators.spread import carry_long, dense_positions, exact_medians
from loadcast.session import shared_folder


def test_positions_are_dense_and_survive_a_write(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.choice([None, 1, 1, 1, rng.randrange(50)]), i) for i in range(2000)]
    placed = dense_positions(spark.createDataFrame(data, "k int, i int"), ["k"], ranges=7)
    placed.repartition(5).write.parquet(str(tmp_path / "x"))
    back = [r for r in spark.read.parquet(str(tmp_path / "x")).orderBy("posicao").collect()]
    assert [r.posicao for r in back] == list(range(1, 2001)) and sorted(r.i for r in back) == list(range(2000))
    keys = [-1 if r.k is None else r.k for r in back]
    assert keys == sorted(keys)
    assert dense_positions(spark.createDataFrame([], "k int, i int"), ["k"]).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_medians_are_exact(spark, seed):
    rng = random.Random(seed)
    groups = {"a": [rng.gauss(0, 1) for _ in range(1001)], "b": [rng.choice([1.0, 2.0]) for _ in range(500)], "c": [3.5],
              None: [math.exp(rng.gauss(0, 40)) for _ in range(300)], "e": [-1.7e308, 1.7e308, 5e-324, 0.0, -5e-324],
              "f": [float("-inf"), 1.0, 2.0, float("inf")], "g": [0.1 + k * 1e-17 for k in range(8)] + [1e9]}
    data = [(g, x) for g, xs in groups.items() for x in xs + [None, float("nan")]] + [("h", None)]
    got = {r.g: r.x for r in exact_medians(spark.createDataFrame(data, "g string, x double"), ["g"], "x").collect()}
    assert got == {g: median(xs) for g, xs in groups.items()}


def test_carry_equals_a_loop(spark):
    rng = random.Random(3)
    series = {k: [rng.random() if rng.random() < 0.2 else None for _ in range(200)] for k in ("a", None)}
    series["c"], series["d"] = [None] * 30, [None] * 25 + [1.0] + [None] * 25
    data = [(k, i // 10, i, x) for k, xs in series.items() for i, x in enumerate(xs)]
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "k string, c int, i int, x double")
    got = {(r.k, r.i): r.x for r in carry_long(rows, ["k"], "c", ["i"], "x").collect()}
    for k, xs in series.items():
        first, last = next((x for x in xs if x is not None), None), None
        for i, x in enumerate(xs):
            last = x if x is not None else last
            assert got[(k, i)] == (last if last is not None else first)
    assert len(got) == len(data)


def test_carry_reads_a_long_chunk_and_a_long_series_once(spark):
    """A frame that ends after its row is summed anew for each row: 200,000 missing values were 20 billion steps."""
    n = 200_000
    late = F.when(F.col("i") == n - 1, 7.0)
    rows = spark.range(2 * n).select((F.col("id") >= n).alias("k"), (F.col("id") % n).alias("i")).withColumn("x", late)
    rows = rows.withColumn("c", F.when(F.col("k"), F.col("i")).otherwise(F.lit(0)))     # a chunk of n rows, n chunks of one
    filled = carry_long(rows, ["k"], "c", ["i"], "x")
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RowFrame, (\S+),", plan)
    assert frames and set(frames) == {"unboundedpreceding$()"}
    assert filled.columns == rows.columns
    assert [tuple(r) for r in filled.groupBy("k", "x").count().orderBy("k").collect()] == [(False, 7.0, n), (True, 7.0, n)]


class Session:
    """The settings of a session on a cluster."""

    def __init__(self, master, **conf):
        self.conf = self.sparkContext = self
        self.master, self.settings = master, {"spark.sql.warehouse.dir": "file:/home/me/warehouse", **conf}

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getCheckpointDir(self):
        return None


def test_a_machine_local_folder_is_refused_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077"))
    assert shared_folder(Session("local[8]")) == "file:/home/me/warehouse/loadcast-shared"
    assert shared_folder(Session("yarn", **{"spark.sql.warehouse.dir": "hdfs://a/w/"})) == "hdfs://a/w/loadcast-shared"
    assert shared_folder(Session("yarn", **{"spark.checkpoint.dir": "file:/mnt/shared"})) == "file:/mnt/shared"
