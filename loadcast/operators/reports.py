"""Summaries of forecasts and of history. All are one or two aggregates over day x region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.text import lookup
from loadcast.schema import (BOTTOM_UP_NAME, CLIMATE_ASKED, CLIMATE_INPUTS, DAY, HISTOGRAM_BINS,
                             HOURS_PER_DAY, LEVEL_INPUT, LOAD, NATIONAL, REGION_NAMES,
                             SEASON_HALF_WIDTH, SUB, SUBSYSTEMS)

FORECAST = "previsao_mwmed"
REGION = "regiao"


def with_region_name(df: DataFrame) -> DataFrame:
    return df.withColumn(REGION, lookup(REGION_NAMES, F.col(SUB)))


def period_summary(forecast: DataFrame) -> DataFrame:
    """Indicators per region for any period, highest mean first."""
    value = F.col(FORECAST)
    aggs = [F.count(F.lit(1)).alias("dias"), F.avg(value).alias("mwmed_medio"),
            F.min(value).alias("mwmed_min"), F.max(value).alias("mwmed_max"),
            (F.sum(value) * HOURS_PER_DAY / 1e6).alias("energia_TWh"),
            F.try_divide(F.avg(value), F.max(value)).alias("fator_carga"),
            F.min(DAY).alias("de"), F.max(DAY).alias("ate")]
    if "nivel_industrial" in forecast.columns:
        aggs.append(F.avg("nivel_industrial").alias("nivel_medio"))
    if "resposta_climatica" in forecast.columns:
        aggs.append(F.avg("resposta_climatica").alias("resposta_climatica_media"))
    if "origem" in forecast.columns:
        supplied = F.count_if(F.col("origem") == "arquivo")
        aggs += [supplied.alias("dias_do_arquivo"),
                 (F.count(F.lit(1)) - supplied).alias("dias_estimados")]
    return forecast.groupBy(REGION, SUB).agg(*aggs).orderBy(F.desc("mwmed_medio"))


def compare_observed(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """Error report on the days that exist in the history; empty when none does."""
    seen = history.select(SUB, DAY, LOAD)
    both = forecast.select(REGION, SUB, DAY, FORECAST).join(seen, [SUB, DAY], "inner")
    error = F.abs(F.col(FORECAST) - F.col(LOAD))
    bias = (F.try_divide(F.avg(FORECAST), F.avg(LOAD)) - 1) * 100
    return (both.groupBy(REGION, SUB)
            .agg(F.count(F.lit(1)).alias("dias_comparados"),
                 F.avg(FORECAST).alias("mwmed_previsto"), F.avg(LOAD).alias("mwmed_observado"),
                 bias.alias("erro_medio_pct"), F.avg(error).alias("mae_diario"),
                 (F.avg(F.try_divide(error, F.col(LOAD))) * 100).alias("mape_diario_pct"))
            .orderBy(F.desc("mwmed_observado")))


def annual_observed(history: DataFrame, year: int) -> DataFrame:
    return (history.filter(F.year(DAY) == year).groupBy(SUB)
            .agg(F.avg(LOAD).alias("real_mwmed")))


def annual_vs_observed(summary: DataFrame, observed: DataFrame) -> DataFrame:
    """Projected against observed annual mean per region."""
    return (summary.select(REGION, SUB, "mwmed_medio").join(observed, SUB, "inner")
            .withColumn("erro_pct", (F.try_divide(F.col("mwmed_medio"), F.col("real_mwmed")) - 1) * 100))


def bottom_up_annual(summary: DataFrame, observed: DataFrame) -> DataFrame:
    """The regions plus a row that adds the four subsystems against the national observation.

    The added row exists only where all four subsystems and the observed nation do. The summary
    has one row per region, so this aggregate is five rows wide.
    """
    rows = annual_vs_observed(summary, observed)
    part = F.col(SUB).isin(SUBSYSTEMS)
    national = F.col(SUB) == NATIONAL
    added = (summary.select(SUB, "mwmed_medio").join(observed, SUB, "left")
             .agg(F.count_if(part).alias("parts"),
                  F.count_if(national & F.col("real_mwmed").isNotNull()).alias("nations"),
                  F.sum(F.when(part, F.col("mwmed_medio"))).alias("mwmed_medio"),
                  F.max(F.when(national, F.col("real_mwmed"))).alias("real_mwmed"))
             .filter((F.col("parts") == len(SUBSYSTEMS)) & (F.col("nations") > 0))
             .select(F.lit(BOTTOM_UP_NAME).alias(REGION), F.lit(BOTTOM_UP_NAME).alias(SUB),
                     "mwmed_medio", "real_mwmed",
                     ((F.try_divide(F.col("mwmed_medio"), F.col("real_mwmed")) - 1) * 100).alias("erro_pct")))
    return rows.unionByName(added)


def coverage_summary(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy(SUB).agg(
        F.count(F.lit(1)).alias("linhas"), F.countDistinct(DAY).alias("dias_distintos"),
        F.min(DAY).alias("de"), F.max(DAY).alias("ate"), F.avg("temp_mean").alias("temp_media"),
        F.avg("n_estacoes").alias("estacoes"), F.avg(LEVEL_INPUT).alias("industrial"))


def monthly_profile(forecast: DataFrame) -> DataFrame:
    return (forecast.groupBy(REGION, F.month(DAY).alias("mes"))
            .agg(F.avg(FORECAST).alias("previsao_media")))


def _season_days(days: DataFrame, half_width: int) -> DataFrame:
    """Each distinct (region, day of year) with the neighbouring days of the year it looks at.

    At most 366 x 21 rows per region, whatever the number of requests. The window is not circular.
    """
    doy = F.dayofyear(DAY)
    return (days.select(SUB, doy.alias("dia_ano")).distinct()
            .withColumn("vizinho", F.explode(F.sequence(F.col("dia_ano") - half_width,
                                                        F.col("dia_ano") + half_width))))


def season_context(days: DataFrame, history: DataFrame,
                   half_width: int = SEASON_HALF_WIDTH) -> DataFrame:
    """Load and temperature statistics around each asked day of the year, else of all history.

    History is first reduced to sums per day of the year, at most 366 rows a region, and the asked days are put among
    them as rows without values. A window over the number of the day gives the neighbourhood, so no row is
    repeated and nothing that is shuffled grows with the width. The window is not circular.
    """
    sums = [F.sum("s").alias("s"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.sum("ts").alias("ts"), F.sum("tc").alias("tc"), F.sum("n").alias("n")]
    per_doy = history.groupBy(SUB, F.dayofyear(DAY).alias("dia_ano")).agg(
        F.sum(LOAD).alias("s"), F.count(LOAD).alias("c"), F.min(LOAD).alias("lo"),
        F.max(LOAD).alias("hi"), F.sum("temp_mean").alias("ts"), F.count("temp_mean").alias("tc"),
        F.count(F.lit(1)).alias("n"))
    asked = days.select(SUB, F.dayofyear(DAY).alias("dia_ano")).distinct().withColumn("pedido", F.lit(True))
    placed = per_doy.unionByName(asked, allowMissingColumns=True).groupBy(SUB, "dia_ano").agg(
        *sums, F.bool_or("pedido").alias("pedido"))
    fields = {"carga_media": lambda w: F.try_divide(F.sum("s").over(w), F.sum("c").over(w)),
              "carga_min": lambda w: F.min("lo").over(w), "carga_max": lambda w: F.max("hi").over(w),
              "temp_media": lambda w: F.try_divide(F.sum("ts").over(w), F.sum("tc").over(w)),
              "n_dias": lambda w: F.sum("n").over(w)}
    whole = Window.partitionBy(SUB)
    near = whole.orderBy("dia_ano").rangeBetween(-half_width, half_width)
    context = placed.select(SUB, "dia_ano", "pedido", *[f(near).alias(c) for c, f in fields.items()],
                            *[f(whole).alias(f"all_{c}") for c, f in fields.items()]).where("pedido")
    empty = F.col("n_dias").isNull() | F.col("dia_ano").isNull()
    return context.select(SUB, "dia_ano", *[
        F.when(empty, F.col(f"all_{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def season_deviation(forecast: DataFrame, context: DataFrame) -> DataFrame:
    """Forecast minus the season's mean, and the response's share of the forecast."""
    return (forecast.withColumn("dia_ano", F.dayofyear(DAY))
            .join(context.select(SUB, "dia_ano", "carga_media"), [SUB, "dia_ano"], "left")
            .select(SUB, DAY, FORECAST,
                    (F.col(FORECAST) - F.col("carga_media")).alias("desvio"),
                    (F.try_divide(F.col("resposta_climatica"), F.col(FORECAST)) * 100)
                    .alias("parcela_resposta_pct")))


def season_histogram(days: DataFrame, history: DataFrame, bins: int = HISTOGRAM_BINS,
                     half_width: int = SEASON_HALF_WIDTH) -> DataFrame:
    """Equal-width histogram of the loads in the season window; the top edge is in the last bin."""
    past = history.select(SUB, LOAD, F.dayofyear(DAY).alias("vizinho"))
    window = _season_days(days, half_width).join(past, [SUB, "vizinho"])
    edges = window.groupBy(SUB, "dia_ano").agg(F.min(LOAD).alias("lo"), F.max(LOAD).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.coalesce(F.try_divide(F.col(LOAD) - F.col("lo"), width), F.lit(bins // 2))
    return (window.join(edges, [SUB, "dia_ano"])
            .withColumn("faixa", F.least(F.lit(bins), F.floor(bin_no).cast("int") + 1))
            .groupBy(SUB, "dia_ano", "faixa").agg(F.count(F.lit(1)).alias("dias")))


def sensitivity(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of the forecast over a sweep, absolute and as percent of its mean."""
    spread = F.max(FORECAST) - F.min(FORECAST)
    return curve.groupBy(*keys).agg(
        spread.alias("variacao_mwmed"),
        (F.try_divide(spread, F.avg(FORECAST)) * 100).alias("variacao_pct"))


def field_ranges(history: DataFrame) -> DataFrame:
    """Input range per region and field: observed range widened by a quarter on both sides."""
    cells = history.select(SUB, *CLIMATE_ASKED).unpivot([SUB], CLIMATE_ASKED, "campo", "valor")
    margin = (F.max("valor") - F.min("valor")) * 0.25
    return cells.groupBy(SUB, "campo").agg(
        F.round(F.min("valor") - margin, 1).alias("minimo"),
        F.round(F.max("valor") + margin, 1).alias("maximo"),
        F.round(F.median("valor"), 1).alias("padrao"))


def observed_climate(history: DataFrame, year: int) -> DataFrame:
    cols = [c for c in CLIMATE_INPUTS if c in history.columns]
    return history.filter(F.year(DAY) == year).select(SUB, DAY, *cols)


def worsening_pivot(contamination: DataFrame, groups: list[str]) -> DataFrame:
    """(region, mode) x group table of percent worsening."""
    return contamination.groupBy(SUB, "modo").pivot("grupo", groups).agg(F.avg("piora_pct"))


def temperature_sweep(scenarios: DataFrame, history: DataFrame, steps: int = 60,
                      low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Evenly spaced temperatures, both ends included, for each scenario row.

    The default range is the region's own mean temperature range widened by 2 degrees; max and min
    follow at half the median daily range. Other columns of a scenario stay fixed.
    """
    ranges = history.groupBy(SUB).agg(
        F.min("temp_mean").alias("t_lo"), F.max("temp_mean").alias("t_hi"),
        F.median(F.col("temp_max") - F.col("temp_min")).alias("amplitude"))
    lo = low if low is not None else F.col("t_lo") - 2
    hi = high if high is not None else F.col("t_hi") + 2
    step = (F.col("hi") - F.col("lo")) / max(steps - 1, 1)
    temp = F.when((F.col("passo") == steps - 1) & (F.col("passo") > 0), F.col("hi")
                  ).otherwise(F.col("lo") + F.col("passo") * step)
    scenarios = scenarios.drop("temp_mean")
    edge = {"temp_max": F.col("temp_mean") + F.col("amplitude") / 2,
            "temp_min": F.col("temp_mean") - F.col("amplitude") / 2}
    edge = {c: F.coalesce(F.col(f"fixed_{c}"), e) if c in scenarios.columns else e
            for c, e in edge.items()}
    rest = [c for c in scenarios.columns if c not in (SUB, DAY, *edge)]
    return (scenarios.withColumnsRenamed({c: f"fixed_{c}" for c in edge})
            .join(ranges, SUB)
            .withColumn("lo", lo).withColumn("hi", hi)
            .withColumn("passo", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
            .withColumn("temp_mean", temp)
            .select(SUB, DAY, *rest, "passo", "temp_mean", *[e.alias(c) for c, e in edge.items()]))
