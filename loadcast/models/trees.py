"""Boosted-tree models per region: the climatic residual and the next-day change."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadcast.models.boosting import FOREST, ROW, TARGET, UNIT, Forest, Settings, fit_forests, forest_rows, forests_of
from loadcast.models.level import LEVEL, apply_level, fill_level_input, fit_level
from loadcast.operators.metrics import PRED
from loadcast.schema import AUTOREGRESSIVE, DAY, LOAD, SUB, mode_features
from loadcast.session import written

RESPONSE = "resposta_climatica"
FORECAST = "previsao_mwmed"
RECORD = f"modo string, {SUB} string, ano_treino int, atributos array<string>, caminho string"


class MissingModel(Exception):
    """No fitted package for this mode and region."""


def label_column(mode: str) -> F.Column:
    """What the trees learn: load minus level, or load minus yesterday's load."""
    return F.col(LOAD) - F.col(LEVEL if mode == "climatico" else "carga_ontem")


@dataclass
class Package:
    """All regions of one mode: the level as a small table, one forest per region."""

    mode: str
    features: list[str]
    level: DataFrame
    trees: dict[str, Forest]
    train_year: int | None = None

    def decompose(self, df: DataFrame) -> DataFrame:
        """Adds level, climate response and their sum; in delta modes yesterday and the change."""
        base = F.col(LEVEL) if self.mode == "climatico" else F.col("carga_ontem")
        return self.score(apply_level(df, self.level)).withColumn(FORECAST, base + F.col(RESPONSE))

    def fitted(self, df: DataFrame) -> DataFrame:
        """The rows of regions that have a model; forecasting any other row is an error."""
        return df.filter(F.col(SUB).isin(list(self.trees)))

    def score(self, prepared: DataFrame) -> DataFrame:
        """One pass over the rows in Arrow batches; a row is scored by its own region's trees, missing values as such."""
        shared = prepared.sparkSession.sparkContext.broadcast(self.trees)       # rounds x nodes x regions

        @F.pandas_udf("double")
        def respond(region: pd.Series, *columns: pd.Series) -> pd.Series:
            out = np.full(len(region), np.nan)
            inputs = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            for name, forest in shared.value.items():
                own = np.flatnonzero(region == name)
                if len(own):
                    out[own] = forest.predict(inputs[own])
            return pd.Series(out)

        unfitted = F.raise_error(F.concat(F.lit("no fitted model for region "), F.col(SUB))).cast("double")
        answer = respond(SUB, *[F.col(f).cast("double") for f in self.features])
        return prepared.withColumn(RESPONSE, answer).withColumn(
            RESPONSE, F.when(F.col(SUB).isin(list(self.trees)), F.col(RESPONSE)).otherwise(unfitted))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.decompose(df).withColumnRenamed(FORECAST, PRED)

    def predict_delta(self, df: DataFrame) -> DataFrame:
        """The predicted change alone, without yesterday's load."""
        return self.decompose(df).drop(FORECAST).withColumnRenamed(RESPONSE, "delta")

    def importance(self, spark: SparkSession) -> DataFrame:
        """(region, feature, importance): one row per model input, driver-sized by construction."""
        rows = [(region, name, float(share)) for region, forest in self.trees.items()
                for name, share in zip(self.features, forest.importance(len(self.features)))]
        return spark.createDataFrame(rows, f"{SUB} string, atributo string, importancia double")

    def save(self, path: str) -> None:
        """Trees, level, and last a record of mode, region, train year and features for each model."""
        spark, folder = self.level.sparkSession, f"{path}/{self.mode}"
        rows = [r for region, forest in self.trees.items() for r in forest_rows(region, forest)]
        spark.createDataFrame(rows, FOREST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/trees")
        self.level.write.mode("overwrite").parquet(f"{folder}/level")
        record = [(self.mode, region, self.train_year, self.features, folder) for region in self.trees]
        spark.createDataFrame(record, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{folder}/record")


def fit_package(mode: str, train: DataFrame, **overrides) -> Package:
    """Fit one mode for all regions of a training table; keyword arguments override the boosting settings."""
    features, settings = mode_features(mode, train.columns), Settings(**overrides)
    needed = [LOAD] + (AUTOREGRESSIVE if mode != "climatico" else [])
    train = fill_level_input(train.dropna(subset=needed))
    level = fit_level(train)
    target = F.round(label_column(mode) * UNIT).cast("long")
    rows = written(apply_level(train, level).select(SUB, F.xxhash64(SUB, DAY).alias(ROW), target.alias(TARGET),
                                                    F.year(DAY).alias("ano_do_dia"), *features))
    year = rows.agg(F.max("ano_do_dia")).first()[0]
    return Package(mode, features, level, fit_forests(rows.drop("ano_do_dia"), features, settings), year)


def load_package(spark: SparkSession, path: str, mode: str, regions: list[str]) -> Package:
    folder = f"{path}/{mode}"
    try:
        record = spark.read.schema(RECORD).parquet(f"{folder}/record").collect()
    except Exception as error:
        raise MissingModel(f"no fitted model for {mode} in {path}") from error
    if absent := sorted(set(regions) - {r[SUB] for r in record}):
        raise MissingModel(f"no fitted model for {mode}/{', '.join(absent)} in {path}")
    trees = spark.read.schema(FOREST).parquet(f"{folder}/trees").filter(F.col(SUB).isin(regions))
    return Package(mode, list(record[0]["atributos"]), spark.read.parquet(f"{folder}/level"),
                   forests_of(trees.collect()), record[0]["ano_treino"])


def registered_models(spark: SparkSession, paths: list[str], modes: list[str]) -> DataFrame:
    """The records of all packages below some folders; a folder without a mode is passed over by its reader alone."""
    return spark.read.schema(RECORD).parquet(*[f"{p}/{m}/record" for p in paths for m in modes])


def model_as_of(records: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (mode, region, year) the model of the latest train year before it; none is an error.

    Records are one row a mode, region and train year, so the join multiplies a question by at most the years on record.
    """
    known = records.select("modo", SUB, "ano_treino", "atributos", "caminho")
    best = (asked.join(known, ["modo", SUB], "left")
            .filter(F.col("ano_treino").isNull() | (F.col("ano_treino") < F.col("ano")))
            .groupBy("modo", SUB, "ano").agg(F.max("ano_treino").alias("ano_treino"),
                                             F.max_by("atributos", "ano_treino").alias("atributos"),
                                             F.max_by("caminho", "ano_treino").alias("caminho")))
    none = F.raise_error(F.concat_ws(" ", F.lit("no fitted model for"), "modo", SUB, F.lit("before"), "ano")).cast("int")
    return asked.join(best, ["modo", SUB, "ano"], "left").withColumn(
        "ano_treino", F.coalesce("ano_treino", none))


def top_features(package: Package, spark: SparkSession, top: int | None = 5) -> DataFrame:
    """Features ranked by importance within each region; all of them when ``top`` is None."""
    order = Window.partitionBy(SUB).orderBy(F.desc("importancia"), "atributo")
    ranked = package.importance(spark).withColumn("posicao", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("posicao") <= top)
