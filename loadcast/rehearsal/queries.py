"""The query registry: every operator, run over the star-schema test tables.

Fractional results are rounded, so that two engines that add in a different order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.functions.calendar import calendar_features, is_holiday
from loadcast.functions.text import label_lower, label_upper
from loadcast.functions.thermal import coherent_max, coherent_min, hours_above
from loadcast.models.level import fill_level_input, LEVEL, apply_level, fit_level, level_predictor
from loadcast.models.trees import Package, fit_package, load_package, model_as_of, registered_models, top_features
from loadcast.operators import grid, industrial, metrics, national, permutation, reports, series, spread
from loadcast.operators.climate import (dedup_station_days, map_station_region, regional_climate,
                                        station_day)
from loadcast.operators.quality import quality_control
from loadcast.operators.recursive import recursive_forecast
from loadcast.plans import climate_job, dataset, dataset_job, scoring, serving
from loadcast.rehearsal import files
from loadcast.rehearsal import views as v
from loadcast.schema import (AUTOREGRESSIVE, CLIMATE_INPUTS, DAY, FEATURE_GROUPS, INDUSTRIAL,
                             LOAD, SEED_DAYS, STATION, SUB, SUB_NAME, SUBSYSTEM_NAMES, SUBSYSTEMS,
                             mode_features)
from loadcast.session import STORE, written
from loadcast.sources import load as load_source
from loadcast.sources import user_tables
from loadcast.sources.sinks import brazilian_text, publish, read_by_year, read_published, write_by_year
from loadcast.sources.stations import read_stations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LEVEL_DIGITS = 3            # regression results lose digits to cancellation


def query(digits: int = 6):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)
        QUERIES[fn.__name__] = run
        return fn
    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round fractional columns; adding zero turns a negative zero into zero."""
    return df.select(*[(F.round(F.col(f.name), digits) + 0.0).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def train_rows(spark, sf):
    return v.year_rows(v.dataset_table(spark, sf), v.TRAIN_YEAR)


def test_rows(spark, sf):
    return v.year_rows(v.dataset_table(spark, sf), v.TEST_YEAR)


def load_days(spark, sf):
    return v.load_table(spark, sf)


# sources

@query()
def load_scan(spark, sf):
    """Load written as one semicolon file set, an unknown subsystem among it, and scanned back."""
    folder = STORE.folder(spark, sf, "load-csv")
    days = load_days(spark, sf).withColumn(SUB_NAME, v.lookup(SUBSYSTEM_NAMES, F.col(SUB)))
    stray = days.filter(F.col(SUB) == "SE").withColumns({SUB: F.lit("XX"), SUB_NAME: F.lit("?")})
    (days.unionByName(stray).select(SUB, SUB_NAME, DAY, LOAD)
     .write.mode("overwrite").csv(folder, sep=";", header=True))
    return load_source.read_load(spark, folder).orderBy(SUB, DAY)


@query()
def station_file_scan(spark, sf):
    """Every event written as a line of a station file, and scanned back."""
    found = read_stations(spark, files.station_files(spark, sf), files.STATION_GLOB)
    return found.drop("arquivo").withColumn(STATION, F.col(STATION).cast("int"))


@query()
def station_climate_job(spark, sf):
    """Station files of every year to regional climate, through the yearly cache."""
    path = files.station_files(spark, sf)
    years = [r[0] for r in v.readings_from_events(spark, sf).select(F.year(DAY)).distinct().collect()]
    rows = climate_job.climate_of_years(spark, {y: f"{path}/ano={y}" for y in sorted(years)},
                                        STORE.folder(spark, sf, "climate-cache"), files.STATION_GLOB)
    return rows.drop("ano")


@query()
def dataset_sink_scan(spark, sf):
    """The model dataset written by year and scanned back."""
    path = STORE.folder(spark, sf, "dataset-by-year")
    write_by_year(v.dataset_table(spark, sf), path)
    return read_by_year(spark, path)


@query()
def user_folder_scan(spark, sf):
    """Accepted rows of all files that users sent, in four dialects."""
    accepted, _ = user_tables.read_user_tables(spark, files.user_folder(spark, sf))
    return accepted.select(SUB, DAY, "temp_mean")


@query()
def user_file_rejects(spark, sf):
    """Folders and reasons of rejected files; how many files a folder has is up to its writer."""
    _, rejected = user_tables.read_user_tables(spark, files.user_folder(spark, sf))
    return rejected.filter(~F.col("arquivo").rlike("^[._]")).groupBy("pasta", "motivo").agg(
        (F.count(F.lit(1)) > 0).alias("arquivos"))


@query()
def csv_br_format(spark, sf):
    climate = v.climate_table(spark, sf)
    return brazilian_text(climate.select(SUB, DAY, F.round("temp_mean", 4).alias("temp_mean"), "rad_sum"))


# user input

@query()
def normalize_label(spark, sf):
    rows = v.user_rows(spark, sf)
    return rows.select("o_orderkey", label_upper(F.col("regiao")).alias("maiuscula"),
                       label_lower(F.col("regiao")).alias("minuscula"))


@query()
def region_lookup(spark, sf):
    rows = v.user_rows(spark, sf)
    return rows.select("o_orderkey", user_tables.region_code(F.col("regiao")).alias(SUB))


@query()
def region_rejects(spark, sf):
    _, rejected = user_tables.normalize_inputs(v.user_rows(spark, sf))
    return user_tables.unknown_labels(rejected)


@query()
def reject_rows(spark, sf):
    """Every rejected row with its label as written and the reason."""
    _, rejected = user_tables.normalize_inputs(v.user_rows(spark, sf))
    return rejected.select("o_orderkey", "rotulo", "motivo")


@query()
def alias_rename(spark, sf):
    return user_tables.rename_columns(v.user_rows(spark, sf)).select("o_orderkey", SUB, DAY)


@query()
def reject_reasons(spark, sf):
    _, rejected = user_tables.normalize_inputs(v.user_rows(spark, sf))
    return rejected.groupBy("motivo").agg(F.count(F.lit(1)).alias("linhas"))


@query()
def user_dates(spark, sf):
    rows = v.user_rows(spark, sf)
    return rows.select("o_orderkey", user_tables.user_date(F.col("data")).alias(DAY))


@query()
def user_numbers(spark, sf):
    rows = v.user_rows(spark, sf)
    return rows.select("o_orderkey", user_tables.localized_number(F.col("temperatura")).alias("temp_mean"))


@query()
def user_inputs(spark, sf):
    accepted, _ = user_tables.normalize_inputs(v.user_rows(spark, sf))
    return accepted


# stations and climate

@query()
def qc_readings(spark, sf):
    checked = quality_control(v.readings_from_events(spark, sf))
    return checked.select("event_id", "temp", "umid", "rad", "vento", "precip")


def event_station_days(spark, sf, keys=(STATION,)):
    readings = map_station_region(quality_control(v.readings_from_events(spark, sf)))
    return station_day(readings, [*keys, SUB])


@query()
def station_day_stats(spark, sf):
    return event_station_days(spark, sf)


@query()
def dedup_keep_last(spark, sf):
    """The same station-day in several source files: the file that sorts last wins."""
    readings = map_station_region(quality_control(v.readings_from_events(spark, sf)))
    per_file = station_day(readings, ["arquivo", STATION, SUB], min_readings=1)
    return dedup_station_days(per_file)


@query()
def events_regional_climate(spark, sf):
    return regional_climate(event_station_days(spark, sf))


@query()
def lineitem_regional_climate(spark, sf):
    return v.climate_by_region(spark, sf)


@query()
def clamp_temps(spark, sf):
    """Upper and lower temperature exchanged and moved, then made coherent with the mean."""
    t_mean, t_max, t_min = F.col("temp_mean"), F.col("temp_min") + 0.5, F.col("temp_max") - 0.5
    return v.climate_table(spark, sf).select(
        SUB, DAY, coherent_max(t_max, t_mean).alias("temp_max"),
        coherent_min(t_min, t_mean).alias("temp_min"))


@query()
def daily_hours_above(spark, sf):
    hours = hours_above(26.0, F.col("temp_mean"), F.col("temp_max"), F.col("temp_min"))
    return v.climate_table(spark, sf).select(SUB, DAY, hours.alias("horas"))


# industrial

@query()
def sheet_blocks(spark, sf):
    return industrial.sheet_months(v.sheet(spark, sf))


def load_bounds(spark, sf):
    return dataset.day_bounds(load_days(spark, sf))


@query()
def interp_daily(spark, sf):
    return industrial.industrial_levels(v.industrial_table(spark, sf), *load_bounds(spark, sf))


@query()
def interp_step(spark, sf):
    return industrial.industrial_levels(v.industrial_table(spark, sf), *load_bounds(spark, sf),
                                        mode="step")


@query()
def interp_daily_national(spark, sf):
    levels = industrial.industrial_levels(v.industrial_table(spark, sf), *load_bounds(spark, sf))
    return industrial.with_national_level(levels)


@query()
def annual_change(spark, sf):
    return industrial.industrial_daily(v.industrial_table(spark, sf), *load_bounds(spark, sf))


@query()
def serving_industrial(spark, sf):
    """Run-up of 400 days before the test year, so the annual change is real from its first day."""
    days = v.year_rows(load_days(spark, sf), v.TEST_YEAR)
    return serving.serving_industrial(days, v.industrial_table(spark, sf))


# panel and features

@query()
def panel_join(spark, sf):
    rows = dataset.panel(load_days(spark, sf), v.climate_table(spark, sf), v.industrial_table(spark, sf))
    return rows.select(SUB, DAY, LOAD, "temp_mean", "n_estacoes", *INDUSTRIAL)


@query()
def missing_climate(spark, sf):
    return dataset.missing_climate(load_days(spark, sf).join(v.climate_table(spark, sf), [SUB, DAY], "left"))


@query()
def load_shares(spark, sf):
    return national.load_shares(load_days(spark, sf), v.TRAIN_YEAR)


@query()
def national_aggregate(spark, sf):
    rows = dataset.panel(load_days(spark, sf), v.climate_table(spark, sf), v.industrial_table(spark, sf))
    return national.national_rows(rows, national.load_shares(load_days(spark, sf), v.TRAIN_YEAR))


@query()
def load_lags(spark, sf):
    return series.load_lags(load_days(spark, sf))


@query()
def calendar_lags(spark, sf):
    """Lags over the densified series: by calendar day instead of by row."""
    return series.load_lags(series.densify(load_days(spark, sf)))


@query()
def trailing_mean_7(spark, sf):
    return series.trailing_mean(load_days(spark, sf))


@query()
def thermal_inertia(spark, sf):
    rows = load_days(spark, sf).join(v.climate_table(spark, sf), [SUB, DAY], "left")
    return series.thermal_inertia(rows).select(SUB, DAY, "amplitude_termica", "graus_refrig_med3",
                                               "temp_mean_ontem")


@query()
def fill_both_ways(spark, sf):
    """Gaps in the joined climate filled forward, then backward."""
    rows = series.densify(load_days(spark, sf))
    return rows.select(SUB, DAY, series.fill_both_ways(F.col(LOAD)).alias(LOAD))


@query()
def carry_readings(spark, sf):
    """Rain of every reading of a station: the last one known, else the first, over series split by day."""
    rows = v.readings_from_events(spark, sf).select("event_id", DAY, STATION, "precip")
    return spread.carry_long(rows, [STATION], DAY, [DAY, "event_id"], "precip")


@query()
def reading_medians(spark, sf):
    """Exact medians of all line-item readings of a region, by sensor."""
    rows = v.readings_from_lineitem(spark, sf).join(v.supplier_subs(spark, sf), STATION)
    sensors = ["temp", "umid", "rad", "vento", "precip"]
    return spread.exact_medians(rows.unpivot([SUB], sensors, "sensor", "mediana"), [SUB, "sensor"], "mediana")


@query()
def input_positions(spark, sf):
    """Places of all accepted user rows by day and key, written in another order and read back."""
    placed = spread.dense_positions(order_inputs(spark, sf).select("o_orderkey", SUB, DAY), [DAY, "o_orderkey"])
    return written(placed.repartition(SUB))


@query()
def calendar_columns(spark, sf):
    """Calendar features of every order day, straight from the raw order rows."""
    orders = v.read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias(DAY))
    return calendar_features(orders)


@query()
def holiday_flags(spark, sf):
    days = load_days(spark, sf).select(DAY).distinct()
    return days.select(DAY, is_holiday(F.col(DAY)).cast("int").alias("is_feriado"),
                       is_holiday(F.date_add(DAY, 1)).cast("int").alias("is_vespera_feriado"))


@query()
def model_dataset(spark, sf):
    return dataset.build_dataset(load_days(spark, sf), v.climate_table(spark, sf),
                                 v.industrial_table(spark, sf), v.TRAIN_YEAR)


@query()
def dataset_changed_years(spark, sf):
    """The dataset from files, first with one year's loads wrong and incomplete, then with that year's file mended."""
    path, root, year = files.dataset_files(spark, sf), STORE.folder(spark, sf, "dataset-years"), v.TRAIN_YEAR - 2
    sources, right = files.dataset_sources(spark, sf, path), load_days(spark, sf)
    wrong = right.filter(F.dayofmonth(DAY) % 3 > 0).withColumn(LOAD, F.col(LOAD) * 2)
    for rows in (wrong, right):
        files.write_load_year(rows, path, year)
        built, _ = dataset_job.dataset_of_years(spark, sources, root, v.TRAIN_YEAR)
    return built


@query()
def model_dataset_strict(spark, sf):
    """The leak-free variant: step level, real annual change from the first day, the nation's own change."""
    rows = dataset.build_dataset(load_days(spark, sf), v.climate_table(spark, sf),
                                 v.industrial_table(spark, sf), v.TRAIN_YEAR, mode="step",
                                 run_up_days=400, own_national_change=True)
    return rows.select(SUB, DAY, *INDUSTRIAL)


@query()
def features_climatico(spark, sf):
    rows = v.dataset_table(spark, sf)
    return rows.select(SUB, DAY, *mode_features("climatico", rows.columns))


# grid and climatology

@query()
def region_medians(spark, sf):
    return grid.region_medians(v.dataset_table(spark, sf))


@query()
def climatology_raw(spark, sf):
    return grid.climatology_raw(v.dataset_table(spark, sf))


@query()
def climatology_smooth(spark, sf):
    return grid.climatology(v.dataset_table(spark, sf))


@query()
def climatology_fallback(spark, sf):
    """Climatology for all regions when the history of the nation is taken away."""
    normal = v.normal_table(spark, sf)
    known = normal.filter(F.col(SUB).isin(SUBSYSTEMS))
    return grid.climatology_with_fallback(known, normal.select(SUB).distinct())


@query()
def daily_grid(spark, sf):
    days = load_days(spark, sf)
    lo, hi = load_bounds(spark, sf)
    return grid.daily_grid(days.select(SUB).distinct(), lo, hi)


def supplied_days(spark, sf):
    """One row per station and day of all years, with some cells left empty; nothing after the last ship day."""
    days = station_day(v.readings_from_lineitem(spark, sf), [STATION], min_readings=1)
    coded = days.join(v.supplier_subs(spark, sf), STATION)
    return coded.select(SUB, DAY, STATION,
                        F.when(F.dayofmonth(DAY) % 5 != 0, F.col("temp_mean")).alias("temp_mean"),
                        "umid_mean")


@query()
def complete_period(spark, sf):
    return grid.complete_period(supplied_days(spark, sf), v.normal_table(spark, sf), [STATION])


@query()
def missing_regions(spark, sf):
    return grid.missing_regions(v.all_regions(spark, sf), supplied_days(spark, sf))


@query()
def project_year_inputs(spark, sf):
    supplied = grid.keep_last(supplied_days(spark, sf), [SUB, DAY], [STATION]).drop(STATION)
    return serving.year_inputs(v.TEST_YEAR, v.all_regions(spark, sf), v.normal_table(spark, sf), supplied)


@query()
def normal_year_inputs(spark, sf):
    return serving.year_inputs(v.TEST_YEAR + 1, v.all_regions(spark, sf), v.normal_table(spark, sf))


@query()
def fill_region_median(spark, sf):
    rows = v.dataset_table(spark, sf).select(SUB, DAY, *CLIMATE_INPUTS)
    return serving.fill_region_median(rows, v.medians_table(spark, sf))


def order_inputs(spark, sf):
    """Accepted user rows as forecast inputs: every order asks for one region and day."""
    accepted, _ = user_tables.normalize_inputs(v.user_rows(spark, sf))
    return accepted.withColumn("temp_mean", F.col("temp_mean") / 10000)


@query()
def serving_features(spark, sf):
    rows = serving.serving_features(order_inputs(spark, sf), v.medians_table(spark, sf),
                                    v.industrial_table(spark, sf), validated=True)
    return rows.select("o_orderkey", SUB, DAY, *CLIMATE_INPUTS, "is_feriado", "dia_semana",
                       "graus_refrig", "graus_aquec", "horas_acima_26", "amplitude_termica",
                       "graus_refrig_med3", "temp_mean_ontem", *INDUSTRIAL)


@query()
def observed_climate(spark, sf):
    return reports.observed_climate(v.dataset_table(spark, sf), v.TEST_YEAR)


def sweep_scenarios(spark, sf):
    """One scenario per region and day of the test year."""
    return test_rows(spark, sf).select(SUB, DAY)


@query()
def temperature_sweep_inputs(spark, sf):
    return reports.temperature_sweep(sweep_scenarios(spark, sf), v.dataset_table(spark, sf))


# level model and reports on its forecast

@query(LEVEL_DIGITS)
def level_fit(spark, sf):
    return fit_level(train_rows(spark, sf))


def level_days(spark, sf):
    """Test-year forecast by the level alone, with the columns of a full forecast."""
    scored = apply_level(test_rows(spark, sf), fit_level(train_rows(spark, sf)))
    response = F.col("temp_mean") - 20
    return reports.with_region_name(
        scored.withColumn(reports.FORECAST, F.col(LEVEL))
        .withColumn("resposta_climatica", response)
        .withColumn("origem", F.when(F.col("temp_mean").isNull(), "climatologia").otherwise("arquivo"))
        .select(SUB, DAY, LEVEL, "resposta_climatica", reports.FORECAST, "origem"))


@query(LEVEL_DIGITS)
def level_forecast(spark, sf):
    return level_days(spark, sf)


@query(LEVEL_DIGITS)
def period_summary(spark, sf):
    return reports.period_summary(level_days(spark, sf))


@query(LEVEL_DIGITS)
def compare_observed(spark, sf):
    return reports.compare_observed(level_days(spark, sf), v.dataset_table(spark, sf))


@query()
def annual_observed(spark, sf):
    return reports.annual_observed(v.dataset_table(spark, sf), v.TEST_YEAR)


@query(LEVEL_DIGITS)
def annual_vs_observed(spark, sf):
    return reports.annual_vs_observed(reports.period_summary(level_days(spark, sf)),
                                      reports.annual_observed(v.dataset_table(spark, sf), v.TEST_YEAR))


@query(LEVEL_DIGITS)
def bottom_up_annual(spark, sf):
    return reports.bottom_up_annual(reports.period_summary(level_days(spark, sf)),
                                    reports.annual_observed(v.dataset_table(spark, sf), v.TEST_YEAR))


@query()
def coverage_summary(spark, sf):
    return reports.coverage_summary(v.dataset_table(spark, sf))


@query(LEVEL_DIGITS)
def monthly_profile(spark, sf):
    return reports.monthly_profile(level_days(spark, sf))


@query()
def season_context(spark, sf):
    return reports.season_context(test_rows(spark, sf), v.dataset_table(spark, sf))


@query(LEVEL_DIGITS)
def season_deviation(spark, sf):
    context = reports.season_context(test_rows(spark, sf), v.dataset_table(spark, sf))
    return reports.season_deviation(level_days(spark, sf), context)


@query()
def season_histogram(spark, sf):
    return reports.season_histogram(test_rows(spark, sf), v.dataset_table(spark, sf))


@query(LEVEL_DIGITS)
def sensitivity(spark, sf):
    """Spread over the year of the level forecast, in place of a temperature sweep."""
    return reports.sensitivity(level_days(spark, sf), [SUB])


@query(LEVEL_DIGITS)
def sweep_sensitivity(spark, sf):
    """Spread of the level plus a degree per degree, over the temperature sweep of every day."""
    levels = level_days(spark, sf).select(SUB, DAY, LEVEL)
    swept = temperature_sweep_inputs(spark, sf).join(levels, [SUB, DAY])
    return reports.sensitivity(swept.withColumn(reports.FORECAST, F.col(LEVEL) + F.col("temp_mean") - 20), [SUB, DAY])


@query()
def field_ranges(spark, sf):
    return reports.field_ranges(v.dataset_table(spark, sf))


@query(LEVEL_DIGITS)
def error_series(spark, sf):
    rows = level_predictor(fit_level(train_rows(spark, sf)))(test_rows(spark, sf))
    return metrics.error_series(rows.select(SUB, DAY, LOAD, metrics.PRED))


# baselines and scores

def baseline(spark, sf, name):
    return metrics.baseline_table(train_rows(spark, sf), test_rows(spark, sf)).select(SUB, DAY, LOAD, name)


@query()
def baseline_mean(spark, sf):
    return baseline(spark, sf, "media_treino")


@query()
def baseline_climatology(spark, sf):
    return baseline(spark, sf, "climatologia")


@query()
def baseline_persistence(spark, sf):
    return baseline(spark, sf, "persistencia")


@query()
def baseline_week(spark, sf):
    return baseline(spark, sf, "semana_anterior")


def level_predictions(spark, sf):
    return level_predictor(fit_level(train_rows(spark, sf)))(test_rows(spark, sf)).select(
        SUB, DAY, LOAD, metrics.PRED)


@query(LEVEL_DIGITS)
def forecast_metrics(spark, sf):
    return metrics.forecast_metrics(level_predictions(spark, sf), [SUB])


@query(LEVEL_DIGITS)
def bottom_up_metrics(spark, sf):
    rows = metrics.bottom_up(level_predictions(spark, sf), "climatico")
    return metrics.forecast_metrics(rows, [SUB, metrics.MODE])


@query(LEVEL_DIGITS)
def score_sheet(spark, sf):
    """Baselines, the level forecast as climatic mode, its bottom-up sum, and every gain."""
    return scoring.score_sheet(train_rows(spark, sf), test_rows(spark, sf),
                               {"climatico": level_predictions(spark, sf)})


@query(LEVEL_DIGITS)
def class_gain(spark, sf):
    sheet = score_sheet(spark, sf)
    return sheet.filter(F.col("ganho_pct").isNotNull()).select(SUB, metrics.MODE, "classe", "ganho_pct")


@query(LEVEL_DIGITS)
def accuracy_pivot(spark, sf):
    return metrics.accuracy_pivot(score_sheet(spark, sf), ["climatico", "climatico (soma dos 4)"])


@query()
def shuffle_column(spark, sf):
    rows = test_rows(spark, sf)
    return permutation.shuffle_columns(rows, mode_features("delta_d1", rows.columns))


def level_model(spark, sf):
    """(test rows, the level alone as a model); rows are filled before they are copied and permuted."""
    level = fit_level(train_rows(spark, sf))
    return (fill_level_input(test_rows(spark, sf)),
            lambda rows: apply_level(rows, level).withColumnRenamed(LEVEL, metrics.PRED))


@query(LEVEL_DIGITS)
def contamination_standin(spark, sf):
    """Shuffle test with the level as the model: only the industrial group can matter."""
    rows, level = level_model(spark, sf)
    return permutation.contamination_test(rows, FEATURE_GROUPS, level)


@query(LEVEL_DIGITS)
def importance_standin(spark, sf):
    """Every feature, eight repeats; with the level as the model only its own input can matter."""
    rows, level = level_model(spark, sf)
    return permutation.permutation_importance(rows, mode_features("delta_d1", rows.columns), level)


@query()
def recursive_standin(spark, sf):
    """Recursion with yesterday plus one as the model: the seventh day plus the days since."""
    return recursive_forecast(test_rows(spark, sf), ["temp_mean"],
                              lambda region, row: row["carga_ontem"] + 1.0)


@query()
def recursive_scenarios(spark, sf):
    """Recursion of every test day under 41 temperature shifts, each a series of its own."""
    shifts = F.explode(F.sequence(F.lit(-20), F.lit(20))).alias("cenario")
    rows = test_rows(spark, sf).select(SUB, DAY, LOAD, shifts)
    return recursive_forecast(rows.withColumn("passo", F.col("cenario") / 4), ["passo"],
                              lambda region, row: row["carga_lag7"] + row["passo"], scenario=["cenario"])


# tree models

_packages: dict[tuple, Package] = {}


def package(spark, sf, mode) -> Package:
    """Fitted once per application, saved, and loaded back from the saved models."""
    key = (spark.sparkContext.applicationId, sf, mode)
    if key not in _packages:
        fitted = fit_package(mode, train_rows(spark, sf))
        fitted.save(model_folder(spark, sf))
        _packages[key] = load_package(spark, model_folder(spark, sf), mode, list(fitted.trees))
    return _packages[key]


def model_folder(spark, sf):
    return STORE.folder(spark, sf, "models")


MODES = ["climatico", "delta_d1"]
FORECAST_COLUMNS = [SUB, DAY, LEVEL, "resposta_climatica", reports.FORECAST]


@query()
def climatic_forecast(spark, sf):
    return package(spark, sf, "climatico").decompose(fill_level_input(test_rows(spark, sf))).select(*FORECAST_COLUMNS)


@query()
def delta_forecast(spark, sf):
    rows = test_rows(spark, sf).dropna(subset=AUTOREGRESSIVE)
    return package(spark, sf, "delta_d1").decompose(rows).select(
        SUB, DAY, "carga_ontem", F.col("resposta_climatica").alias("delta"), reports.FORECAST)


@query()
def feature_ranking(spark, sf):
    """All model inputs of both modes, ranked within each region."""
    parts = [top_features(package(spark, sf, mode), spark, top=None).withColumn(metrics.MODE, F.lit(mode))
             for mode in MODES]
    return parts[0].unionByName(parts[1])


def tree_recursive(spark, sf):
    return scoring.recursive_with_trees(package(spark, sf, "delta_d1"), test_rows(spark, sf))


@query()
def recursive_trees(spark, sf):
    return tree_recursive(spark, sf)


@query()
def model_score_sheet(spark, sf):
    test = test_rows(spark, sf)
    climatic = package(spark, sf, "climatico").predict(test)
    delta = package(spark, sf, "delta_d1").predict(test.dropna(subset=AUTOREGRESSIVE))
    recursive = tree_recursive(spark, sf).join(test.select(SUB, DAY, LOAD), [SUB, DAY])
    return scoring.score_sheet(train_rows(spark, sf), test,
                               {"climatico": climatic, "delta_d1": delta, "delta_recursivo": recursive})


@query()
def model_accuracy_pivot(spark, sf):
    modes = ["climatico", "climatico (soma dos 4)", "delta_d1", "delta_recursivo", "delta_recursivo (soma dos 4)"]
    return metrics.accuracy_pivot(model_score_sheet(spark, sf), modes)


def rows_of_modes(spark, sf):
    test = test_rows(spark, sf)
    return {"climatico": test, "delta_d1": test.dropna(subset=AUTOREGRESSIVE)}


def tree_contamination(spark, sf):
    parts = [permutation.contamination_test(rows, FEATURE_GROUPS, package(spark, sf, mode).predict)
             .withColumn(metrics.MODE, F.lit(mode)) for mode, rows in rows_of_modes(spark, sf).items()]
    return parts[0].unionByName(parts[1])


@query()
def contamination_trees(spark, sf):
    return tree_contamination(spark, sf)


@query()
def contamination_pivot(spark, sf):
    return reports.worsening_pivot(tree_contamination(spark, sf), list(FEATURE_GROUPS))


@query()
def permutation_importance(spark, sf):
    parts = []
    for mode, rows in rows_of_modes(spark, sf).items():
        model = package(spark, sf, mode)
        parts.append(permutation.permutation_importance(rows, model.features, model.predict)
                     .withColumn(metrics.MODE, F.lit(mode)))
    return parts[0].unionByName(parts[1])


@query()
def batch_forecast(spark, sf):
    """A forecast for every accepted user row of a region with a model, in the order of the input."""
    climatic = package(spark, sf, "climatico")
    rows = serving.forecast(climatic.fitted(order_inputs(spark, sf)), climatic, v.medians_table(spark, sf),
                            v.industrial_table(spark, sf), validated=True)
    chosen = rows.select("o_orderkey", reports.REGION, *FORECAST_COLUMNS)
    return spread.dense_positions(chosen, ["o_orderkey"]).orderBy("posicao")


@query()
def project_year(spark, sf):
    climatic = package(spark, sf, "climatico")
    rows = serving.project_year(v.TEST_YEAR, climatic.fitted(v.all_regions(spark, sf)), v.normal_table(spark, sf),
                                climatic, v.medians_table(spark, sf),
                                v.industrial_table(spark, sf),
                                reports.observed_climate(v.dataset_table(spark, sf), v.TEST_YEAR))
    return reports.period_summary(rows)


@query()
def response_curve(spark, sf):
    curve = serving.response_curve(sweep_scenarios(spark, sf), v.dataset_table(spark, sf),
                                   package(spark, sf, "climatico"), v.medians_table(spark, sf),
                                   v.industrial_table(spark, sf))
    return curve.select(SUB, DAY, "passo", "temp_mean", reports.FORECAST)


# what must hold of the tree models whatever they learn, each next to keys and columns that SQL can express

def remainder(base):
    return (F.col(reports.FORECAST) - F.col(base) - F.col("resposta_climatica")).alias("resto")


@query(LEVEL_DIGITS)
def climatic_parts(spark, sf):
    """Level and response add up to the forecast, and the level is the regression's."""
    return climatic_forecast(spark, sf).select(SUB, DAY, LEVEL, remainder(LEVEL))


@query(LEVEL_DIGITS)
def delta_parts(spark, sf):
    """Yesterday and the change add up to the forecast."""
    rows = delta_forecast(spark, sf).withColumnRenamed("delta", "resposta_climatica")
    return rows.select(SUB, DAY, "carga_ontem", remainder("carga_ontem"))


@query(LEVEL_DIGITS)
def recursive_seed(spark, sf):
    """The recursion starts from seven observed days and has a forecast for every day."""
    place = F.row_number().over(Window.partitionBy(SUB).orderBy(DAY))
    return recursive_trees(spark, sf).select(
        SUB, DAY, F.when(place <= SEED_DAYS, F.col(metrics.PRED)).alias("semente"),
        F.col(metrics.PRED).isNotNull().alias("previsto"))


@query()
def importance_totals(spark, sf):
    """Importances add up to one over all inputs, and each input has a place of its own."""
    return feature_ranking(spark, sf).groupBy(SUB, metrics.MODE).agg(
        F.sum("importancia").alias("total"), F.count(F.lit(1)).alias("atributos"),
        F.count_distinct("posicao").alias("posicoes"))


@query()
def permutation_places(spark, sf):
    return permutation_importance(spark, sf).groupBy(SUB, metrics.MODE).agg(
        F.count_distinct("coluna").alias("colunas"), F.max("posicao").alias("ultima"))


@query()
def contamination_blind(spark, sf):
    """Observed load, permuted, does not move the climatic mode."""
    rows = tree_contamination(spark, sf)
    return rows.filter((F.col(metrics.MODE) == "climatico") & (F.col("grupo") == "autoregressivo")).select(
        SUB, "grupo", "piora_pct")


@query(LEVEL_DIGITS)
def model_score_baselines(spark, sf):
    """The baselines of the sheet that the models are scored in."""
    rows = model_score_sheet(spark, sf)
    return rows.filter(F.col(metrics.MODE).startswith("[baseline]")).select(SUB, metrics.MODE, "mae", "rmse", "n")


@query()
def project_year_days(spark, sf):
    return project_year(spark, sf).select(reports.REGION, SUB, "dias", "de", "ate", "dias_do_arquivo", "dias_estimados")


@query()
def response_steps(spark, sf):
    return response_curve(spark, sf).select(SUB, DAY, "passo", "temp_mean")


@query(LEVEL_DIGITS)
def batch_parts(spark, sf):
    """Every accepted row has a forecast, its level is the regression's, and the parts add up."""
    return batch_forecast(spark, sf).select("o_orderkey", SUB, DAY, "posicao", LEVEL, remainder(LEVEL))


@query()
def model_registry(spark, sf):
    """The model of the latest train year before the test year, for every region and mode."""
    regions = train_rows(spark, sf).select(SUB).distinct()
    for mode in MODES:
        package(spark, sf, mode)
    asked = regions.select(F.explode(F.array(*map(F.lit, MODES))).alias("modo"), SUB, F.lit(v.TEST_YEAR).alias("ano"))
    found = model_as_of(registered_models(spark, [model_folder(spark, sf)], MODES), asked)
    return found.select(SUB, "modo", "ano", "ano_treino", F.size("atributos").alias("atributos"))


@query(LEVEL_DIGITS)
def published_scores(spark, sf):
    """Score sheet, shuffle test and error series of one job, published together and read back."""
    root = STORE.folder(spark, sf, "results")
    publish(spark, {"placar": score_sheet(spark, sf), "contaminacao": contamination_standin(spark, sf),
                    "series": error_series(spark, sf)}, root)
    return read_published(spark, root, "placar")
