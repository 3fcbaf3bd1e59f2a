"""Shuffle tests: how much the error grows when columns are permuted inside a region."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcast.operators.metrics import PRED
from loadcast.schema import DAY, LOAD, SUB

Predictor = Callable[[DataFrame], DataFrame]


def shuffled_values(test: DataFrame, columns: list[str], seeds: list[int]) -> DataFrame:
    """Long form (semente, region, coluna, day, valor) of every column permuted within its region.

    Rows are ranked once by day and once by a hash, and joined on the rank, so the permutation is
    the same on every run and on any number of executors. Ranks are per region, column and seed:
    a group is as long as the region's days.
    """
    cells = (test.select(SUB, DAY, *[F.col(c).cast("double").alias(c) for c in columns])
             .unpivot([SUB, DAY], columns, "coluna", "valor")
             .withColumn("semente", F.explode(F.array(*[F.lit(s) for s in seeds]))))
    group = Window.partitionBy("semente", SUB, "coluna")
    ticket = F.md5(F.concat_ws("|", "semente", "coluna", SUB, F.col(DAY).cast("string")))
    ranked = cells.select("semente", SUB, "coluna", DAY, "valor",
                          F.row_number().over(group.orderBy(DAY)).alias("place"),
                          F.row_number().over(group.orderBy(ticket)).alias("draw"))
    places = ranked.select("semente", SUB, "coluna", DAY, F.col("place").alias("pos"))
    draws = ranked.select("semente", SUB, "coluna", F.col("draw").alias("pos"), "valor")
    return places.join(draws, ["semente", SUB, "coluna", "pos"]).drop("pos")


def shuffle_columns(test: DataFrame, columns: list[str], seed: int = 0,
                    suffix: str = "_emb") -> DataFrame:
    """Test keys with one permuted copy of each column."""
    return (shuffled_values(test, columns, [seed]).groupBy(SUB, DAY)
            .pivot("coluna", columns).agg(F.first("valor"))
            .select(SUB, DAY, *[F.col(c).alias(c + suffix) for c in columns]))


def _typed(column, like):
    return column.cast(like.dataType)


def contamination_test(test: DataFrame, groups: dict[str, list[str]], predict: Predictor,
                       seed: int = 0) -> DataFrame:
    """Percent MAE growth when a whole feature group is permuted, per region and group.

    Each test row is copied once per group plus once unchanged, and all copies are scored together.
    """
    groups = {g: [c for c in cols if c in test.columns] for g, cols in groups.items()}
    groups = {g: cols for g, cols in groups.items() if cols}
    columns = [c for cols in groups.values() for c in cols]
    names = F.array(F.lit("base"), *[F.lit(g) for g in groups])
    copies = (test.join(shuffle_columns(test, columns, seed), [SUB, DAY])
              .withColumn("grupo", F.explode(names)))
    replaced = {c: F.when(F.col("grupo") == g, _typed(F.col(c + "_emb"), test.schema[c]))
                .otherwise(F.col(c)) for g, cols in groups.items() for c in cols}
    scored = predict(copies.withColumns(replaced).drop(*[c + "_emb" for c in columns]))
    mae = scored.groupBy(SUB, "grupo").agg(F.avg(F.abs(F.col(PRED) - F.col(LOAD))).alias("mae"))
    # one row per region and group from here on
    base = F.max(F.when(F.col("grupo") == "base", F.col("mae"))).over(Window.partitionBy(SUB))
    return (mae.withColumn("mae_base", base).filter(F.col("grupo") != "base")
            .select(SUB, "grupo", "mae_base", F.col("mae").alias("mae_embaralhado"),
                    ((F.try_divide(F.col("mae"), F.col("mae_base")) - 1) * 100).alias("piora_pct")))


def permutation_importance(test: DataFrame, columns: list[str], predict: Predictor,
                           repeats: int = 8, seed: int = 0) -> DataFrame:
    """Mean MAE growth per column over several permutations, ranked within each region."""
    columns = [c for c in columns if c in test.columns]
    drawn = shuffled_values(test, columns, list(range(seed, seed + repeats)))
    base_copy = test.withColumn("coluna", F.lit("")).withColumn("semente", F.lit(seed))
    copies = test.join(drawn, [SUB, DAY])
    copies = copies.withColumns({
        c: F.when(F.col("coluna") == c, _typed(F.col("valor"), test.schema[c])).otherwise(F.col(c))
        for c in columns}).drop("valor")
    scored = predict(copies.unionByName(base_copy))
    mae = scored.groupBy(SUB, "coluna", "semente").agg(
        F.avg(F.abs(F.col(PRED) - F.col(LOAD))).alias("mae"))
    per_column = mae.groupBy(SUB, "coluna").agg(F.avg("mae").alias("mae"))
    base = F.max(F.when(F.col("coluna") == "", F.col("mae"))).over(Window.partitionBy(SUB))
    growth = (per_column.withColumn("base", base).filter(F.col("coluna") != "")
              # adding in another order moves the last digits, which must not decide a rank
              .select(SUB, "coluna", (F.round(F.col("mae") - F.col("base"), 6) + 0.0).alias("piora_mae")))
    rank = F.row_number().over(Window.partitionBy(SUB).orderBy(F.desc("piora_mae"), "coluna"))
    return growth.withColumn("posicao", rank)
