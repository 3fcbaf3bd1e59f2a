"""Level and tree models, baselines, metrics, shuffle tests and recursion."""

from dataclasses import replace
from datetime import date
from math import sqrt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import days, rows
from loadcast.functions.calendar import calendar_features
from loadcast.models import boosting, level, trees
from loadcast.operators import metrics, permutation, series
from loadcast.operators.metrics import MODE, PRED
from loadcast.operators.recursive import recursive_forecast
from loadcast.plans import scoring
from loadcast.schema import (AUTOREGRESSIVE, CLIMATE, DAY, FEATURE_GROUPS, INDUSTRIAL, LEVEL_INPUT, LOAD, SUB)

PAIR = f"{SUB} string, {DAY} date, {LOAD} double, {PRED} double"


def made(spark, regions=("N", "SE"), n=420):
    """A daily panel whose load follows temperature and the industrial level."""
    rng = np.random.default_rng(7)
    base = [c for c in CLIMATE if c not in ("graus_refrig_med3", "temp_mean_ontem", "amplitude_termica")]
    data = []
    for k, s in enumerate(regions):
        for i, d in enumerate(days("2023-12-01", n)):
            temp = 24 + 6 * np.sin(i / 20) + rng.normal()
            ind = 1000.0 * (k + 1) + i
            cells = {c: float(rng.normal()) for c in base}
            cells.update(temp_mean=None if i == 40 else float(temp), temp_max=float(temp + 4), temp_min=float(temp - 4),
                         graus_refrig=float(max(0, temp - 22)))
            data.append((s, d, float(2 * ind + 80 * temp), *[cells[c] for c in base], ind, 0.0))
    cols = ", ".join(f"{c} double" for c in [*base, *INDUSTRIAL])
    df = spark.createDataFrame(data, f"{SUB} string, {DAY} date, {LOAD} double, {cols}")
    return series.autoregressive_features(series.thermal_inertia(calendar_features(df)))


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    made(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def split(panel):
    return panel.filter("ano = 2024 and mes <= 9"), panel.filter("ano = 2024 and mes > 9")


@pytest.fixture(scope="module")
def climatic(split):
    return trees.fit_package("climatico", split[0], rounds=8)


@pytest.fixture(scope="module")
def delta(spark, split, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    trees.fit_package("delta_d1", split[0], rounds=8).save(folder)
    return trees.load_package(spark, folder, "delta_d1", ["N", "SE"]), folder


# metrics and baselines

def test_metrics_skip_missing_pairs(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([("N", d, 100.0, 110.0), ("N", d, 200.0, 190.0), ("N", d, None, 1.0),
                                ("N", d, 1.0, None), ("N", d, float("nan"), 1.0), ("S", d, None, 5.0)], PAIR)
    n, s = rows(metrics.forecast_metrics(df, [SUB]), SUB)
    assert (n["mae"], n["rmse"], n["n"]) == (10.0, 10.0, 2)
    assert n["mape"] == pytest.approx(7.5) and n["r2"] == pytest.approx(1 - 200 / 5000)
    assert (s["mae"], s["r2"], s["n"]) == (None, None, 0)


def test_metrics_of_zero_and_constant_load(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([("N", d, 0.0, 1.0), ("N", d, 0.0, 3.0)], PAIR)
    r = metrics.forecast_metrics(df, [SUB]).first()
    assert (r.mape, r.r2) == (None, None) and r.rmse == pytest.approx(sqrt(5))


def test_baselines_fill_the_missing_leap_day(spark):
    schema = f"{SUB} string, {DAY} date, {LOAD} double, carga_ontem double, carga_lag7 double"
    train = spark.createDataFrame([("N", d, float(i), None, None) for i, d in enumerate(days("1999-01-01", 365))], schema)
    test = spark.createDataFrame([("N", d, 1.0, None, 2.0) for d in days("2000-01-01", 366)], schema)
    got = rows(metrics.baseline_table(train, test), DAY)
    assert got[365]["climatologia"] == got[364]["climatologia"] == 364.0 and got[0]["media_treino"] == 182.0
    long = metrics.baseline_predictions(train, test)
    assert {r[MODE] for r in long.select(MODE).distinct().collect()} == {
        "[baseline] media_treino", "[baseline] climatologia", "[baseline] semana_anterior"}


def test_gain_is_against_the_same_information_class(spark):
    m = spark.createDataFrame([("N", "[baseline] media_treino", 100.0), ("N", "[baseline] climatologia", 80.0),
                               ("N", "[baseline] persistencia", 20.0), ("N", "climatico", 40.0),
                               ("N", "delta_d1", 10.0)], f"{SUB} string, {MODE} string, mae double")
    got = {r[MODE]: r.ganho_pct for r in metrics.class_gain(m).collect()}
    assert got["climatico"] == pytest.approx(50.0) and got["delta_d1"] == pytest.approx(50.0)
    assert got["[baseline] persistencia"] is None


def test_bottom_up_drops_incomplete_days(spark):
    a, b = date(2024, 1, 1), date(2024, 1, 2)
    data = [(s, a, 1.0, 10.0) for s in ("N", "NE", "S", "SE")] + [("SIN", a, 44.0, 0.0), ("N", b, 1.0, 10.0)]
    got = metrics.bottom_up(spark.createDataFrame(data, PAIR), "climatico").collect()
    assert [(r[DAY], r[LOAD], r[PRED]) for r in got] == [(a, 44.0, 40.0)]


# level

def test_level_extrapolates_and_falls_back_to_the_mean(spark):
    schema = f"{SUB} string, {DAY} date, {LOAD} double, {LEVEL_INPUT} double"
    train = spark.createDataFrame(
        [("N", d, 10.0 + 2 * i, float(i)) for i, d in enumerate(days("2024-01-01", 10))]
        + [("S", d, 5.0 + i, None) for i, d in enumerate(days("2024-01-01", 3))]
        + [("SE", d, 7.0 + i, 3.0) for i, d in enumerate(days("2024-01-01", 3))], schema)
    fit = {r[SUB]: (r.inclinacao, r.intercepto) for r in level.fit_level(train).collect()}
    assert fit["N"] == pytest.approx((2.0, 10.0)) and fit["S"] == (0.0, 6.0) and fit["SE"] == (0.0, 8.0)
    far = spark.createDataFrame([("N", date(2025, 1, 1), None, 100.0)], schema)
    assert level.apply_level(far, level.fit_level(train)).first()[level.LEVEL] == pytest.approx(210.0)


# trees

def test_level_plus_response_is_the_forecast(climatic, split):
    for r in climatic.decompose(split[1]).collect():
        assert r[level.LEVEL] + r[trees.RESPONSE] == pytest.approx(r[trees.FORECAST])


def test_one_pass_scoring_equals_each_regions_own_model(climatic, split):
    together = {(r[SUB], r[DAY]): r[trees.RESPONSE] for r in climatic.decompose(split[1]).collect()}
    for region, forest in climatic.trees.items():
        own = split[1].filter(F.col(SUB) == region).select(DAY, *climatic.features).toPandas()
        alone = forest.predict(own[climatic.features].to_numpy(dtype=float, na_value=np.nan))
        assert [together[(region, d)] for d in own[DAY]] == alone.tolist()
    plan = climatic.decompose(split[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 0


def plain_boosting(rows, features, s):
    """One region's trees from nested loops over rows: the definition, without bins or arrays."""
    predicted = [sum(r["y"] for r in rows) // len(rows)] * len(rows)
    edges = [sorted({r[f] for r in rows if r[f] is not None}) for f in features]

    def tree(members, depth):
        grad = {i: predicted[i] - rows[i]["y"] for i in members}
        total = sum(grad.values())
        best = (0, None)
        for f, name in enumerate(features if depth < s.depth else []):
            for missing_left in (False, True):
                for edge in edges[f]:
                    left = [i for i in members if (missing_left if rows[i][name] is None else rows[i][name] <= edge)]
                    if s.min_child <= len(left) <= len(members) - s.min_child:
                        over = total - sum(grad[i] for i in left)
                        score = (sum(grad[i] for i in left) ** 2 / (len(left) + s.l2)
                                 + over ** 2 / (len(members) - len(left) + s.l2) - total ** 2 / (len(members) + s.l2))
                        if score > best[0]:
                            best = (score, left)
        if best[1] is None:
            return {i: round(-s.rate * total / (len(members) + s.l2)) for i in members}
        right = [i for i in members if i not in set(best[1])]
        return tree(best[1], depth + 1) | tree(right, depth + 1)

    for _ in range(s.rounds):
        step = tree(list(range(len(rows))), 0)
        predicted = [p + step[i] for i, p in enumerate(predicted)]
    return predicted


@pytest.fixture(scope="module")
def boosting_rows(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    data = []
    for region in ("N", "SE", "S"):
        for i in range(60):
            a, b = int(rng.integers(0, 9)), round(float(rng.normal()), 2)
            c = None if rng.random() < 0.3 else float(rng.integers(0, 4))
            y = int(1024 * (30 * a + 50 * (b > 0) + (400 if c is None else 20 * c) + rng.integers(0, 9)))
            data.append((region, i + 1000, y, a, b, c))
    path = str(tmp_path_factory.mktemp("boost") / "rows")
    schema = f"{SUB} string, {boosting.ROW} long, {boosting.TARGET} long, a int, b double, c double"
    spark.createDataFrame(data, schema).repartition(5).write.parquet(path)
    return spark.read.parquet(path), path


def test_boosting_equals_nested_loops(boosting_rows):
    s = boosting.Settings(rounds=6, depth=3, rows=1.0, columns=1.0, rate=0.3)
    forests = boosting.fit_forests(boosting_rows[0], ["a", "b", "c"], s)
    for region, forest in forests.items():
        own = [r.asDict() | {"y": r[boosting.TARGET]} for r in boosting_rows[0].filter(F.col(SUB) == region).collect()]
        inputs = np.array([[np.nan if r[k] is None else r[k] for k in "abc"] for r in own], float)
        assert (forest.predict(inputs) * boosting.UNIT).tolist() == plain_boosting(own, ["a", "b", "c"], s)


def test_level_aggregates_give_the_same_trees(boosting_rows):
    s = boosting.Settings(rounds=5, depth=3, bins=16, settle_rounds=2)
    apart = boosting.fit_forests(boosting_rows[0], ["a", "b", "c"], s)
    together = boosting.fit_forests(boosting_rows[0], ["a", "b", "c"], replace(s, local_rows=10))
    assert set(apart) == set(together) == {"N", "SE", "S"}
    for region in apart:
        assert boosting.forest_rows(region, apart[region]).__repr__() == boosting.forest_rows(region, together[region]).__repr__()


def test_root_splits_equal_sql(boosting_rows):
    """The first split of every region, from sums that DuckDB takes."""
    s = boosting.Settings(rounds=1, rows=1.0, columns=1.0)
    forests = boosting.fit_forests(boosting_rows[0], ["a", "b", "c"], s)
    sql = f"""
      WITH t AS (SELECT {SUB} AS region, r.{boosting.TARGET} AS y, f, v FROM '{boosting_rows[1]}/*.parquet' r,
             LATERAL (VALUES (0, a::DOUBLE), (1, b), (2, c)) x(f, v)),
      g AS (SELECT *, floor(avg(y) OVER (PARTITION BY region)) - y AS g FROM t),
      e AS (SELECT DISTINCT region, f, v AS edge FROM t WHERE v IS NOT NULL),
      l AS (SELECT e.region, e.f, edge, m.m, sum(g) FILTER (coalesce(v <= edge, m.m)) AS gl,
              count(*) FILTER (coalesce(v <= edge, m.m)) AS hl, sum(g) AS gt, count(*) AS ht
            FROM e JOIN g ON g.region = e.region AND g.f = e.f, (VALUES (false), (true)) m(m) GROUP BY ALL)
      SELECT region, f, edge, m FROM l WHERE hl >= 5 AND ht - hl >= 5
      QUALIFY row_number() OVER (PARTITION BY region ORDER BY
        gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) DESC, f, m, edge) = 1"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    assert {r: (int(f.feature[0, 0]), float(f.threshold[0, 0]), bool(f.missing_left[0, 0])) for r, f in forests.items()} == want


def test_registry_looks_up_by_year(spark, climatic, delta, tmp_path):
    climatic.save(str(tmp_path / "a"))
    replace(climatic, train_year=2020).save(str(tmp_path / "b"))
    records = trees.registered_models(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["climatico"])
    asked = spark.createDataFrame([("climatico", "N", 2021), ("climatico", "N", 2024), ("climatico", "SE", 2030)],
                                  f"modo string, {SUB} string, ano int")
    got = {(r[SUB], r.ano): r for r in trees.model_as_of(records, asked).collect()}
    assert {k: r.ano_treino for k, r in got.items()} == {("N", 2021): 2020, ("N", 2024): 2020, ("SE", 2030): 2024}
    assert got[("SE", 2030)].atributos == climatic.features
    with pytest.raises(Exception, match="no fitted model for climatico N before 2020"):
        trees.model_as_of(records, asked.withColumn("ano", F.lit(2020))).collect()


def test_rows_of_unfitted_regions_are_errors(climatic, delta, split):
    with pytest.raises(Exception, match="no fitted model for region|no fitted level|XX"):
        climatic.predict(split[1].withColumn(SUB, F.lit("XX"))).collect()
    with pytest.raises(Exception, match="no fitted model for region XX"):
        scoring.recursive_with_trees(delta[0], split[1].withColumn(SUB, F.lit("XX")).filter("dia_do_mes >= 0" if "dia_do_mes" in
                                     split[1].columns else "true").dropDuplicates([DAY])).collect()


def test_hotter_days_are_forecast_higher(climatic, split):
    scored = climatic.predict(split[1]).withColumn("hot", F.col("temp_mean") > 26)
    by = {(r[SUB], r.hot): r.m for r in scored.groupBy(SUB, "hot").agg(F.avg(F.col(PRED) - F.col(level.LEVEL)).alias("m")).collect()}
    assert all(by[(s, True)] > by[(s, False)] for s in ("N", "SE"))


def test_missing_climate_is_scored(climatic, panel):
    gap = panel.filter("temp_mean is null")
    assert gap.count() == 2 and climatic.predict(gap).filter(F.col(PRED).isNull()).count() == 0


def test_importance_and_unknown_modes(spark, climatic):
    top = trees.top_features(climatic, spark)
    assert top.groupBy(SUB).count().collect() and {r.posicao for r in top.collect()} == {1, 2, 3, 4, 5}
    total = climatic.importance(spark).groupBy(SUB).agg(F.sum("importancia").alias("t")).collect()
    assert [r.t for r in total] == pytest.approx([1.0, 1.0])
    with pytest.raises(ValueError):
        trees.fit_package("outro", climatic.level)
    assert trees.Settings(rounds=3) == replace(trees.Settings(), rounds=3) and trees.Settings().rounds == 600
    assert not set(climatic.features) & set(AUTOREGRESSIVE)


def test_missing_package(spark, tmp_path):
    with pytest.raises(trees.MissingModel):
        trees.load_package(spark, str(tmp_path), "climatico", ["N"])


def test_saved_delta_model_and_arrays_agree(spark, delta, split):
    package, folder = delta
    test = split[1].dropna(subset=AUTOREGRESSIVE)
    scored = package.decompose(test)
    for r in scored.limit(50).collect():
        assert r[trees.FORECAST] == pytest.approx(r.carga_ontem + r[trees.RESPONSE])
    assert package.predict_delta(test).filter(F.col("delta").isNull()).count() == 0
    again = trees.load_package(spark, folder, "delta_d1", ["N"])
    assert list(again.trees) == ["N"] and again.train_year == 2024 and again.features == package.features


# shuffling

def test_shuffle_is_a_permutation_inside_the_region(panel):
    test = panel.filter("ano = 2024")
    mixed = permutation.shuffle_columns(test, ["temp_max"]).join(test, [SUB, DAY])
    for s in ("N", "SE"):
        got = mixed.filter(F.col(SUB) == s).select("temp_max", "temp_max_emb").collect()
        assert sorted(r.temp_max for r in got) == sorted(r.temp_max_emb for r in got)
        assert sum(r.temp_max != r.temp_max_emb for r in got) > 300
    again = permutation.shuffle_columns(test, ["temp_max"]).join(test, [SUB, DAY])
    assert rows(mixed.select(SUB, DAY, "temp_max_emb"), SUB, DAY) == rows(again.select(SUB, DAY, "temp_max_emb"), SUB, DAY)


def test_climatic_mode_cannot_be_contaminated(climatic, split):
    got = {(r[SUB], r.grupo): r.piora_pct for r in permutation.contamination_test(split[1], FEATURE_GROUPS, climatic.predict).collect()}
    assert len(got) == 8
    assert got[("N", "autoregressivo")] == 0.0 == got[("SE", "autoregressivo")]
    assert got[("N", "clima")] > 10


def test_importance_ranks_the_real_driver_first(climatic, split):
    got = permutation.permutation_importance(split[1], ["temp_mean", "temp_max", "vento_mean", "nada"], climatic.predict, repeats=2)
    assert got.filter("posicao = 1 and coluna = 'vento_mean'").count() == 0 and got.count() == 6


# recursion

def test_recursion_never_reads_load_after_the_seed(spark):
    n = 30
    data = [("SE", d, 100.0 if i < 7 else 9999.0, 9999.0, 9999.0, 9999.0, 0.0) for i, d in enumerate(days("2025-01-01", n))]
    test = spark.createDataFrame(data, f"{SUB} string, {DAY} date, {LOAD} double, carga_ontem double, carga_lag7 double, media_7d double, x double")

    def step(region, row):
        assert not any((v == 9999.0).any() for v in row.values()) and LOAD not in row
        return row["carga_ontem"] + 1.0

    got = [r[PRED] for r in rows(recursive_forecast(test, ["x", *AUTOREGRESSIVE], step), DAY)]
    assert got == [100.0] * 7 + [100.0 + k for k in range(1, n - 6)]
    lagged = recursive_forecast(test, ["x"], lambda region, row: row["carga_lag7"] + row["media_7d"])
    assert rows(lagged, DAY)[7][PRED] == 200.0


def test_scenarios_are_folded_together_and_stay_apart(spark):
    """Scenarios of unequal length, over several slices, equal a loop over each of them."""
    starts = {(s, k): 10.0 * k + len(s) for s in ("N", "NE") for k in range(23)}
    data = [(s, k, d, v + i * i % 5 if i < 7 else -1.0, float(i * k % 11)) for (s, k), v in starts.items()
            for i, d in enumerate(days("2025-01-01", 9 + k % 6))]
    test = spark.createDataFrame(data, f"{SUB} string, cenario int, {DAY} date, {LOAD} double, x double")
    got = recursive_forecast(test, ["x"], lambda region, row: row["carga_lag7"] + row["media_7d"] / 7 + row["x"] - row["carga_ontem"] / 3,
                             scenario=["cenario"], rows_per_slice=60)
    assert {r.fatia for r in got.select(F.spark_partition_id().alias("fatia")).distinct().collect()} != {0}
    want = {}
    for key, v in starts.items():
        own = [r for r in data if r[:2] == key]
        out = [r[3] for r in own[:7]]
        for r in own[7:]:
            out.append(out[-7] + np.mean(out[-7:]) / 7 + r[4] - out[-1] / 3)
        want |= {(*key, r[2]): o for r, o in zip(own, out)}
    found = {(r[SUB], r.cenario, r[DAY]): r[PRED] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_recursion_checks_its_seed(spark):
    short = spark.createDataFrame([("N", d, None if i == 3 else 1.0, 0.0) for i, d in enumerate(days("2025-01-01", 10))],
                                  f"{SUB} string, {DAY} date, {LOAD} double, x double")
    with pytest.raises(ValueError):
        recursive_forecast(short, ["x"], lambda region, row: 0.0, seed_days=3)
    with pytest.raises(Exception, match="missing load"):
        recursive_forecast(short, ["x"], lambda region, row: 0.0).collect()


def test_score_sheet_with_all_modes(spark, climatic, delta, split):
    package, folder = delta
    train, test = split
    recursive = scoring.recursive_with_trees(package, test).join(test.select(SUB, DAY, LOAD), [SUB, DAY])
    sheet = scoring.score_sheet(train, test, {"climatico": climatic.predict(test),
                                              "delta_d1": package.predict(test.dropna(subset=AUTOREGRESSIVE)),
                                              "delta_recursivo": recursive})
    got = {(r[SUB], r[MODE]): r for r in sheet.collect()}
    # no test day has its day of the year in the training months, so that baseline is empty
    assert len(got) == 2 * 7 and all((r.n > 0) == (k[1] != "[baseline] climatologia") for k, r in got.items())
    assert got[("N", "climatico")].ganho_pct is not None and got[("N", "[baseline] media_treino")].ganho_pct is None
