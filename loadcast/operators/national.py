"""Load shares and the load-weighted national aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast.schema import ADDITIVE, DAY, LOAD, NATIONAL, SUB, SUB_NAME, SUBSYSTEMS


def load_shares(panel: DataFrame, reference_year: int) -> DataFrame:
    """Each subsystem's share of mean load over a fixed past year, at most four rows.

    A fixed year keeps the load being forecast out of the weights. If that year is empty
    everywhere, all rows are used.
    """
    in_year = F.year(DAY) == reference_year
    per_sub = (panel.filter(F.col(SUB).isin(SUBSYSTEMS)).groupBy(SUB)
               .agg(F.avg(F.when(in_year, F.col(LOAD))).alias("of_year"),
                    F.avg(LOAD).alias("of_all"), F.count_if(in_year).alias("rows_in_year")))
    everything = Window.partitionBy()       # four rows
    mean = F.when(F.sum("rows_in_year").over(everything) > 0, F.col("of_year")).otherwise(F.col("of_all"))
    return (per_sub.withColumn("mean_load", mean)
            .filter(F.col("mean_load").isNotNull())
            .select(SUB, (F.col("mean_load") / F.sum("mean_load").over(everything)).alias("peso")))


def national_rows(panel: DataFrame, shares: DataFrame,
                  renormalise_missing: bool = False) -> DataFrame:
    """National rows for the days on which all four subsystems are present.

    Load, industrial level and stations add up; every other number is a share-weighted mean. A
    missing cell keeps its weight in the denominator unless ``renormalise_missing`` is set; if
    all cells of a day are missing the result is missing.
    """
    numeric = [f.name for f in panel.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name not in (SUB, DAY)]
    additive = [c for c in numeric if c in ADDITIVE]
    weighted = [c for c in numeric if c not in ADDITIVE]
    peso = F.col("peso")

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0.0)).alias(c)

    def mean(c):
        weight = F.sum(F.when(F.col(c).isNotNull(), peso)) if renormalise_missing else F.sum(peso)
        value = F.coalesce(F.try_divide(F.sum(F.col(c) * peso), weight), F.lit(0.0))
        return F.when(F.count(c) > 0, value).alias(c)

    rows = (panel.filter(F.col(SUB).isin(SUBSYSTEMS))
            .join(F.broadcast(shares), SUB, "left")     # at most four rows
            .groupBy(DAY)
            .agg(*[total(c) for c in additive], *[mean(c) for c in weighted],
                 F.countDistinct(SUB).alias("n_subs"))
            .filter(F.col("n_subs") == len(SUBSYSTEMS)).drop("n_subs")
            .withColumn(SUB, F.lit(NATIONAL)))
    if SUB_NAME in panel.columns:
        rows = rows.withColumn(SUB_NAME, F.lit(NATIONAL))
    return rows


def with_national(panel: DataFrame, reference_year: int) -> DataFrame:
    rows = national_rows(panel, load_shares(panel, reference_year))
    return panel.unionByName(rows, allowMissingColumns=True)
