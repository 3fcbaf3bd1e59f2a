"""Lags, national aggregate, industrial level, climatology, completion and reports on literals."""

from datetime import date, timedelta
from math import asin, pi

import pytest
from pyspark.sql import functions as F

from helpers import days, rows
from loadcast.functions.calendar import calendar_features, easter
from loadcast.functions.thermal import hours_above
from loadcast.operators import grid, industrial, national, reports, series
from loadcast.plans import dataset, serving
from loadcast.schema import (AUTOREGRESSIVE, CLIMATE_INPUTS, DAY, FEATURE_GROUPS, INDUSTRIAL, LOAD, SUB,
                             mode_features)

PANEL = f"{SUB} string, {DAY} date, {LOAD} double, temp_mean double, industrial_mwmed double, n_estacoes double"
LOADS = {"N": 7000.0, "NE": 12000.0, "S": 11000.0, "SE": 45000.0}
TEMPS = {"N": 27.0, "NE": 26.0, "S": 19.0, "SE": 23.0}


def ramp(spark, n, step=1.0, sub="SE"):
    return spark.createDataFrame([(sub, d, i * step) for i, d in enumerate(days("2024-01-01", n))],
                                 f"{SUB} string, {DAY} date, {LOAD} double")


def four(spark, n=10, skip=None):
    data = [(s, d, LOADS[s], TEMPS[s], LOADS[s] * 0.3, 50.0) for s in LOADS for d in days("2024-01-01", n)
            if (s, d) != skip]
    return spark.createDataFrame(data, PANEL)


# lags

def test_trailing_mean_excludes_today(spark):
    got = rows(series.trailing_mean(ramp(spark, 20)), DAY)
    assert [r["media_7d"] for r in got[:7]] == [None] * 7
    assert got[14]["media_7d"] == pytest.approx(10.0)


def test_lags_stay_inside_the_region(spark):
    both = ramp(spark, 15, 10.0).unionByName(ramp(spark, 15, 1000.0, "N"))
    got = [r for r in rows(series.load_lags(both), SUB, DAY) if r[SUB] == "SE"]
    assert got[0]["carga_ontem"] is None
    assert got[5]["carga_ontem"] == 40.0 and got[10]["carga_lag7"] == 30.0


def test_null_load_makes_the_trailing_mean_null(spark):
    df = ramp(spark, 10).withColumn(LOAD, F.when(F.col(LOAD) != 3, F.col(LOAD)))
    assert rows(series.trailing_mean(df), DAY)[8]["media_7d"] is None


def test_row_lags_and_calendar_lags_differ_at_a_hole(spark):
    holed = ramp(spark, 10).filter(F.col(LOAD) != 4)
    by_row = {r[DAY]: r["carga_ontem"] for r in series.load_lags(holed).collect()}
    by_day = {r[DAY]: r["carga_ontem"] for r in series.load_lags(series.densify(holed)).collect()}
    day = date(2024, 1, 6)
    assert by_row[day] == 3.0 and by_day[day] is None


def test_fill_both_ways(spark):
    df = ramp(spark, 6).withColumn("x", F.when(F.col(LOAD).isin(1, 3), F.col(LOAD)))
    got = [r["y"] for r in rows(df.withColumn("y", series.fill_both_ways(F.col("x"))), DAY)]
    assert got == [1, 1, 1, 3, 3, 3]


def test_no_feature_group_overlap():
    names = [c for g in FEATURE_GROUPS.values() for c in g]
    assert len(names) == len(set(names))
    assert not set(mode_features("climatico", names)) & set(AUTOREGRESSIVE)
    assert set(AUTOREGRESSIVE) <= set(mode_features("delta_d1", names))
    with pytest.raises(ValueError):
        mode_features("outro", names)


# national aggregate

def test_national_sums_and_weighted_mean(spark):
    panel = four(spark)
    shares = {r[SUB]: r.peso for r in national.load_shares(panel, 2024).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["SE"] == pytest.approx(45 / 75)
    got = rows(national.national_rows(panel, national.load_shares(panel, 2024)), DAY)
    assert len(got) == 10
    r = got[0]
    assert (r[SUB], r[LOAD], r["n_estacoes"]) == ("SIN", 75000.0, 200.0)
    assert r["industrial_mwmed"] == pytest.approx(22500.0)
    assert r["temp_mean"] == pytest.approx(sum(shares[s] * TEMPS[s] for s in LOADS))


def test_shares_come_from_the_reference_year_only(spark):
    later = four(spark).withColumns({DAY: F.add_months(DAY, 12), LOAD: F.lit(1.0)})
    both = four(spark).unionByName(later.select(*four(spark).columns))
    shares = {r[SUB]: r.peso for r in national.load_shares(both, 2024).collect()}
    assert shares["SE"] == pytest.approx(0.6)
    fallback = {r[SUB]: r.peso for r in national.load_shares(four(spark), 1990).collect()}
    assert fallback["SE"] == pytest.approx(0.6)


def test_incomplete_day_has_no_national_row(spark):
    panel = four(spark, skip=("SE", date(2024, 1, 5)))
    got = national.national_rows(panel, national.load_shares(panel, 2024))
    assert got.count() == 9 and date(2024, 1, 5) not in {r[DAY] for r in got.collect()}


def test_missing_cell_keeps_its_weight_unless_renormalised(spark):
    panel = four(spark, 1).withColumn("temp_mean", F.when(F.col(SUB) != "SE", F.col("temp_mean")))
    shares = national.load_shares(panel, 2024)
    plain = national.national_rows(panel, shares).first().temp_mean
    fair = national.national_rows(panel, shares, renormalise_missing=True).first().temp_mean
    known = (7 * 27 + 12 * 26 + 11 * 19)
    assert plain == pytest.approx(known / 75) and fair == pytest.approx(known / 30)
    empty = panel.withColumn("temp_mean", F.lit(None).cast("double"))
    assert national.national_rows(empty, shares).first().temp_mean is None


# calendar

def test_calendar_flags(spark):
    want = {date(2024, 3, 29): (1, 0), date(2024, 3, 28): (0, 1), date(2024, 12, 31): (0, 1),
            date(2024, 11, 20): (1, 0), date(2023, 11, 20): (0, 0), date(2025, 4, 18): (1, 0),
            date(2024, 9, 6): (0, 1)}
    df = spark.createDataFrame([(d,) for d in want], f"{DAY} date")
    got = {r[DAY]: (r.is_feriado, r.is_vespera_feriado) for r in calendar_features(df).collect()}
    assert got == want
    sunday = calendar_features(spark.createDataFrame([(date(2024, 1, 7),)], f"{DAY} date")).first()
    assert (sunday.dia_semana, sunday.is_fds, sunday.trimestre) == (6, 1, 1)


def test_easter_dates(spark):
    want = {1818: (3, 22), 1943: (4, 25), 1999: (4, 4), 2000: (4, 23), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}
    df = spark.createDataFrame([(y,) for y in want], "y int")
    assert {r.y: (r.e.month, r.e.day) for r in df.select("y", easter(F.col("y")).alias("e")).collect()} == want


@pytest.mark.parametrize("mean,high,low,hours", [(26, 31, 21, 12.0), (40, 45, 35, 24.0), (10, 14, 6, 0.0),
                                                 (26, 26, 26, 12.0), (28, 32, 24, 24 * (pi + 2 * asin(0.5)) / (2 * pi))])
def test_hours_above(spark, mean, high, low, hours):
    expr = hours_above(26.0, *(F.lit(float(x)) for x in (mean, high, low)))
    assert spark.range(1).select(expr).first()[0] == pytest.approx(hours)


# industrial

def monthly(spark, years=(2023, 2024, 2025)):
    data = [(y, m, s, base + m * 1000.0) for y in years for m in range(1, 13)
            for s, base in (("N", 2e6), ("SE", 9e6))]
    return spark.createDataFrame(data, f"ano int, mes int, {SUB} string, industrial_mwh double")


def day(text):
    return F.lit(text).cast("date")


def test_anchor_value_becomes_visible_two_months_later(spark):
    got = {(r[SUB], r[DAY]): r.industrial_mwmed for r in industrial.industrial_levels(
        monthly(spark), day("2024-01-01"), day("2024-12-31")).collect()}
    assert got[("N", date(2024, 3, 15))] == pytest.approx(2_001_000 / (31 * 24))
    assert got[("N", date(2024, 4, 15))] == pytest.approx(2_002_000 / (29 * 24))
    middle = date(2024, 3, 25)
    a, b = got[("N", date(2024, 3, 15))], got[("N", date(2024, 4, 15))]
    assert got[("N", middle)] == pytest.approx(a + (b - a) * 10 / 31)
    assert len(got) == 2 * 366


def test_flat_beyond_both_ends(spark):
    one = monthly(spark, (2024,)).filter("mes = 1")
    got = [r.industrial_mwmed for r in industrial.industrial_levels(one, day("2024-01-01"), day("2024-06-01")).collect()]
    assert len(got) == 2 * 153 and len(set(got)) == 2


def test_step_mode_never_looks_ahead(spark):
    early = industrial.industrial_levels(monthly(spark), day("2023-01-01"), day("2024-12-31"), mode="step")
    changed = monthly(spark).withColumn("industrial_mwh", F.when(F.col("ano") == 2024, -1.0).otherwise(F.col("industrial_mwh")))
    later = industrial.industrial_levels(changed, day("2023-01-01"), day("2024-12-31"), mode="step")
    before = F.col(DAY) < "2024-03-15"
    assert rows(early.filter(before), SUB, DAY) == rows(later.filter(before), SUB, DAY)
    assert early.agg(F.min(DAY)).first()[0] == date(2023, 3, 15)
    with pytest.raises(ValueError):
        industrial.industrial_levels(monthly(spark), day("2023-01-01"), day("2023-01-02"), mode="cubic")


def test_run_up_makes_the_annual_change_real(spark):
    span = (day("2024-06-01"), day("2024-06-30"))
    without = industrial.industrial_daily(monthly(spark), *span)
    with_it = industrial.industrial_daily(monthly(spark), *span, run_up_days=400).filter(F.col(DAY) >= "2024-06-01")
    assert {r.industrial_var_anual for r in without.collect()} == {0.0}
    assert all(r.industrial_var_anual != 0.0 for r in with_it.collect())
    national_level = with_it.groupBy(DAY).agg(
        (F.sum(F.when(F.col(SUB) != "SIN", F.col("industrial_mwmed")))
         - F.sum(F.when(F.col(SUB) == "SIN", F.col("industrial_mwmed")))).alias("gap"))
    assert national_level.agg(F.max(F.abs("gap"))).first()[0] < 1e-6


def test_sheet_blocks(spark):
    blank = [None] * 11
    grid_rows = [
        (0, "x", ["lixo"] + blank), (1, None, ["2025"] * 12), (2, "TOTAL", ["1"] * 12),
        (3, "Região Geográfica", [None] * 12), (4, "Norte", ["5"] * 12),
        (5, "Subsistema Elétrico", [None] * 12), (6, "Sistemas Isolados", ["6"] * 12),
        (7, "Norte", ["10", "n/d", "30.5"] + [None] * 9), (8, "Sudeste/C.Oeste", ["1"] + blank),
        (9, None, ["2026*"] * 12), (10, "Sul", ["99"] * 12), (11, "SUBSISTEMA  ELÉTRICO", [None] * 12),
        (12, "Sul", ["7"] + blank), (13, "Sul", ["8"] + blank), (14, "Total Brasil", ["3"] * 12), (15, "Sul", ["4"] * 12)]
    cols = ", ".join(f"c{i} string" for i in range(13))
    df = spark.createDataFrame([("I", n, c0, *cells) for n, c0, cells in grid_rows], f"sheet string, row_no int, {cols}")
    got = {(r.ano, r.mes, r[SUB], r.industrial_mwh) for r in industrial.sheet_months(df).collect()}
    assert got == {(2025, 1, "N", 10.0), (2025, 3, "N", 30.5), (2025, 1, "SE", 1.0), (2026, 1, "S", 8.0)}


# grid and serving

def history(spark):
    cells = ", ".join(f"{c} double" for c in CLIMATE_INPUTS)
    data = [(s, d, LOADS[s], *[TEMPS[s] + (i % 7) + k for k in range(len(CLIMATE_INPUTS))])
            for s in LOADS for i, d in enumerate(days("2024-01-01", 366))]
    return spark.createDataFrame(data, f"{SUB} string, {DAY} date, {LOAD} double, {cells}")


def test_climatology_wraps_round_the_year(spark):
    values = {i: float(i) for i in range(1, 367)}
    df = spark.createDataFrame([("N", d, values[i + 1]) for i, d in enumerate(days("2024-01-01", 366))],
                               f"{SUB} string, {DAY} date, temp_mean double")
    got = {r.dia_ano: r.temp_mean for r in grid.climatology(df).collect()}
    import statistics
    wrap = lambda i: (i - 1) % 366 + 1
    for i in (1, 7, 180, 366):
        assert got[i] == statistics.median(values[wrap(i + k)] for k in range(-7, 8))


def test_complete_period_cells_and_origin(spark):
    normal = grid.climatology(history(spark))
    inputs = spark.createDataFrame(
        [("NE", date(2024, 1, 10), 1, 99.0), ("NE", date(2024, 1, 10), 2, 31.0), ("NE", date(2024, 1, 11), 3, None),
         ("NE", date(2024, 1, 12), 4, 33.0)], f"{SUB} string, {DAY} date, row_id int, temp_mean double")
    got = rows(grid.complete_period(inputs, normal, ["row_id"]), DAY)
    assert len(got) == 357 and got[-1][DAY] == date(2024, 12, 31)     # 2024 is a leap year
    assert [r["origem"] for r in got[:4]] == ["arquivo"] * 3 + ["climatologia"]
    assert got[0]["temp_mean"] == 31.0 and got[1]["temp_mean"] not in (None, 31.0)
    assert all(r[c] is not None for r in got for c in CLIMATE_INPUTS)


def test_region_without_history_gets_the_pooled_climate(spark):
    normal = grid.climatology(history(spark))
    inputs = spark.createDataFrame([("SIN", date(2024, 12, 30), 1)], f"{SUB} string, {DAY} date, row_id int")
    got = rows(grid.complete_period(inputs, normal, ["row_id"]), DAY)
    assert len(got) == 2 and got[0]["temp_mean"] is not None


def test_end_before_start_is_an_error(spark):
    inputs = spark.createDataFrame([("N", date(2024, 5, 1), 1)], f"{SUB} string, {DAY} date, row_id int")
    with pytest.raises(Exception, match="before the first"):
        grid.complete_period(inputs, grid.climatology(history(spark)), ["row_id"], until="2024-01-01").collect()


def test_unknown_region_is_an_error(spark):
    inputs = spark.createDataFrame([("marte", date(2024, 5, 1), 1)], f"{SUB} string, {DAY} date, row_id int")
    with pytest.raises(Exception, match="unknown region: marte"):
        grid.complete_period(inputs, grid.climatology(history(spark)), ["row_id"]).collect()


def test_year_inputs_seed_missing_regions(spark):
    wanted = spark.createDataFrame([("N",), ("S",)], f"{SUB} string")
    normal = grid.climatology(history(spark))
    plain = serving.year_inputs(2025, wanted, normal)
    assert plain.count() == 730 and {r.origem for r in plain.collect()} == {"climatologia"}
    given = spark.createDataFrame([("N", date(2025, 3, 1), 31.5), ("SE", date(2025, 3, 1), 31.5)], f"{SUB} string, {DAY} date, temp_mean double")
    got = serving.year_inputs(2025, wanted, normal, given)
    assert got.groupBy(SUB).count().orderBy(SUB).collect() == [("N", 365), ("S", 365)]
    assert got.filter("temp_mean = 31.5").select(SUB, DAY).collect() == [("N", date(2025, 3, 1))]


def test_serving_features_from_minimal_input(spark):
    h = history(spark)
    inputs = spark.createDataFrame([("N", date(2024, 9, 7), 40.0), ("SE", date(2024, 9, 8), None)],
                                   f"{SUB} string, {DAY} date, temp_mean double")
    got = rows(serving.serving_features(inputs, grid.region_medians(h), monthly(spark)), SUB)
    n, se = got
    assert n["temp_max"] == n["temp_mean"] == 40.0 and n["graus_refrig"] == 18.0 and n["is_feriado"] == 1
    assert n["graus_refrig_med3"] == n["graus_refrig"] and n["temp_mean_ontem"] == 40.0
    assert se["temp_mean"] == 26.0 and se["industrial_mwmed"] > n["industrial_mwmed"] > 0
    assert all(r[c] is not None for r in got for c in INDUSTRIAL + ["horas_acima_26", "amplitude_termica"])
    with pytest.raises(ValueError, match="unknown region"):
        serving.serving_features(inputs.withColumn(SUB, F.lit("ZZ")), grid.region_medians(h), monthly(spark))


# reports

def forecast(spark, value=100.0, n=10):
    return spark.createDataFrame([("Norte", "N", d, value + i, "arquivo" if i < 3 else "climatologia")
                                  for i, d in enumerate(days("2024-01-01", n))],
                                 f"regiao string, {SUB} string, {DAY} date, previsao_mwmed double, origem string")


def test_period_summary(spark):
    r = reports.period_summary(forecast(spark)).first()
    assert (r.dias, r.mwmed_medio, r.mwmed_min, r.mwmed_max) == (10, 104.5, 100.0, 109.0)
    assert r.energia_TWh == pytest.approx(1045 * 24 / 1e6) and r.fator_carga == pytest.approx(104.5 / 109)
    assert (r.dias_do_arquivo, r.dias_estimados, r.ate) == (3, 7, date(2024, 1, 10))


def test_compare_observed(spark):
    seen = ramp(spark, 5, 0.0, "N").withColumn(LOAD, F.lit(50.0))
    r = reports.compare_observed(forecast(spark), seen).first()
    assert r.dias_comparados == 5 and r.erro_medio_pct == pytest.approx(104.0) and r.mae_diario == pytest.approx(52.0)
    assert reports.compare_observed(forecast(spark), seen.withColumn(DAY, F.date_add(DAY, 900))).count() == 0


def test_season_context_falls_back_to_all_history(spark):
    past = ramp(spark, 30, 1.0, "N").withColumn("temp_mean", F.lit(20.0))
    asked = spark.createDataFrame([("N", date(2025, 1, 5)), ("N", date(2025, 7, 1))], f"{SUB} string, {DAY} date")
    near, far = rows(reports.season_context(asked, past), "dia_ano")
    assert (near["n_dias"], near["carga_min"], near["carga_max"]) == (15, 0.0, 14.0)
    assert (far["n_dias"], far["carga_media"]) == (30, 14.5)


@pytest.mark.parametrize("width", [0, 3, 10, 200])
def test_season_context_by_nested_loops(spark, width):
    """Two regions with gaps, repeated days, missing loads and days asked outside; nothing is expanded."""
    past = [(s, date(2022 + k % 3, 1, 1) + timedelta(days=(k * 37) % 300), None if k % 9 == 4 else float(k % 50), k % 7 * 1.0)
            for s in ("N", "SE") for k in range(120 if s == "N" else 15)]
    asked = [("N", date(2025, 1, 1) + timedelta(days=k)) for k in range(0, 365, 11)] + [
        ("SE", date(2024, 12, 31)), ("SE", date(2025, 4, 7)), ("N", None)]
    got = reports.season_context(spark.createDataFrame(asked, f"{SUB} string, {DAY} date"), spark.createDataFrame(
        past, f"{SUB} string, {DAY} date, {LOAD} double, temp_mean double"), width)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    doy = lambda d: d.timetuple().tm_yday
    want = set()
    for sub, day in asked:
        region = [r for r in past if r[0] == sub]
        near = [r for r in region if day and abs(doy(r[1]) - doy(day)) <= width] or region
        loads = [r[2] for r in near if r[2] is not None]
        want.add((sub, day and doy(day), round(sum(loads) / len(loads), 6) if loads else None, min(loads, default=None),
                  max(loads, default=None), round(sum(r[3] for r in near) / len(near), 6), len(near)))
    assert {(r[0], r[1], r[2] and round(r[2], 6), r[3], r[4], round(r[5], 6), r[6]) for r in got.collect()} == want


def test_histogram_keeps_every_day(spark):
    past = ramp(spark, 12, 1.0, "N")
    asked = spark.createDataFrame([("N", date(2025, 1, 5))], f"{SUB} string, {DAY} date")
    got = {r.faixa: r.dias for r in reports.season_histogram(asked, past).collect()}
    assert sum(got.values()) == 12 and min(got) == 1 and max(got) == 22
    flat = past.withColumn(LOAD, F.lit(5.0))
    assert [(r.faixa, r.dias) for r in reports.season_histogram(asked, flat).collect()] == [(12, 12)]


def test_sweep_is_inclusive_and_keeps_fixed_fields(spark):
    scenario = spark.createDataFrame([("N", date(2025, 2, 1), 70.0)], f"{SUB} string, {DAY} date, umid_mean double")
    got = rows(reports.temperature_sweep(scenario, history(spark), steps=5), "passo")
    assert len(got) == 5 and got[0]["temp_mean"] == 25.0 and got[-1]["temp_mean"] == 35.0
    assert {r["umid_mean"] for r in got} == {70.0}
    assert got[2]["temp_max"] - got[2]["temp_min"] == pytest.approx(-1 + 0)  # the fixture's range is max - min = -1


def test_bottom_up_needs_all_four(spark):
    summary = spark.createDataFrame([(s, s, v) for s, v in {**LOADS, "SIN": 76000.0}.items()], f"regiao string, {SUB} string, mwmed_medio double")
    seen = spark.createDataFrame([("SIN", 80000.0), ("N", 7000.0)], f"{SUB} string, real_mwmed double")
    got = {r[SUB]: r.erro_pct for r in reports.bottom_up_annual(summary, seen).collect()}
    assert got["SIN (soma dos 4)"] == pytest.approx(-6.25) and got["N"] == 0.0 and len(got) == 3
    assert reports.bottom_up_annual(summary.filter(f"{SUB} <> 'S'"), seen).count() == 2


def test_dataset_has_no_look_ahead(spark):
    """Changing tomorrow's load leaves today's features alone."""
    load = four(spark, 30).select(SUB, DAY, LOAD)
    climate = history(spark).drop(LOAD).withColumns({c: F.lit(1.0) for c in ("graus_refrig", "graus_aquec", "horas_acima_26", "n_estacoes")})
    full = monthly(spark).unionByName(monthly(spark).withColumn(SUB, F.when(F.col(SUB) == "N", "NE").otherwise("S")))
    changed = load.withColumn(LOAD, F.when(F.col(DAY) >= "2024-01-20", 1.0).otherwise(F.col(LOAD)))
    features = lambda d: rows(dataset.build_dataset(d, climate, full, 2023).filter(F.col(DAY) < "2024-01-20")
                              .select(SUB, DAY, *AUTOREGRESSIVE), SUB, DAY)
    first = features(load)
    assert len(first) == 5 * 19 and first == features(changed)


def test_industrial_series_is_as_long_as_the_published_months(spark):
    """Dates far outside it take the nearest end and do not make it longer."""
    m = monthly(spark)
    series = serving.industrial_series(m)
    lo, hi = series.agg(F.min(DAY), F.max(DAY)).first()
    asked = spark.createDataFrame([("N", date(1, 1, 1)), ("N", lo), ("N", hi), ("N", date(9999, 12, 31))],
                                  f"{SUB} string, {DAY} date")
    got = rows(serving.with_industrial(asked, series), DAY)
    assert got[0]["industrial_mwmed"] == got[1]["industrial_mwmed"] and got[3]["industrial_mwmed"] == got[2]["industrial_mwmed"]
    assert {r["industrial_var_anual"] for r in got} == {0.0} and len(got) == 4
    inside = asked.agg(F.lit(lo).alias("a"), F.lit(hi).alias("b"))
    wide = serving.serving_industrial(inside.select(F.explode(F.array("a", "b")).alias(DAY)), m)
    assert rows(wide.filter(F.col(DAY).between(lo, hi)), SUB, DAY) == rows(series.select(wide.columns), SUB, DAY)
