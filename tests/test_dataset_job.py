"""The dataset kept by year: after any change of the files it equals the full build."""

import uuid
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadcast.plans.dataset import build_dataset
from loadcast.plans.dataset_job import Source, dataset_of_years
from loadcast.schema import CLIMATE_DAILY, DAY, LOAD, SUB, SUBSYSTEMS

YEARS = range(2018, 2022)


def noise(*columns):
    return (F.pmod(F.xxhash64(*columns), F.lit(1000)) / 8).cast("double")


@pytest.fixture()
def inputs(spark, tmp_path):
    days = spark.createDataFrame([(s, date(2018, 1, 1) + timedelta(i)) for s in SUBSYSTEMS for i in range(4 * 365 + 1)],
                                 f"{SUB} string, {DAY} date").withColumn("ano", F.year(DAY))
    # a gap over a turn of the year in one region, so that lags and national rows reach far back
    load = days.filter((F.col(SUB) != "NE") | ~F.col(DAY).between("2019-12-20", "2020-02-10")).withColumn(LOAD, noise(SUB, DAY))
    climate = days.select(SUB, DAY, "ano", *[noise(SUB, DAY, F.lit(c)).alias(c) for c in CLIMATE_DAILY],
                          F.lit(3.0).alias("n_estacoes")).filter(F.dayofyear(DAY) % 50 > 0)
    monthly = days.groupBy(SUB, "ano", F.month(DAY).alias("mes")).agg((F.sum(noise(SUB, DAY)) + 1).alias("industrial_mwh"))
    return {name: kept(table, tmp_path) for name, table in {"load": load, "climate": climate, "monthly": monthly}.items()}


def kept(table, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    table.coalesce(1).write.parquet(path)
    return table.sparkSession.read.parquet(path)


def write(tables, path, names, years):
    for name in names:
        for year in years:
            tables[name].filter(F.col("ano") == year).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/{year}")


def full(tables, mode="linear", run_up_days=0):
    return build_dataset(tables["load"].drop("ano"), tables["climate"].drop("ano"), tables["monthly"], 2019, mode=mode,
                         run_up_days=run_up_days)


def same(got, want):
    """Same rows and values, but for the order in which fractions are added up."""
    key = [SUB, DAY]
    got, want = (df.toPandas().set_index(key).sort_index().sort_index(axis=1) for df in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)
    return True


@pytest.mark.parametrize("mode,run_up", [("linear", 0), ("step", 400)])
def test_changed_years_equal_a_full_build(spark, inputs, tmp_path, mode, run_up):
    path = str(tmp_path / "files")

    def sources(years=YEARS):
        return {name: Source({y: f"{path}/{name}/{y}" for y in years}, "*.parquet",
                             lambda y, name=name: spark.read.parquet(f"{path}/{name}/{y}")) for name in inputs}

    def run(years=YEARS):
        return dataset_of_years(spark, sources(years), str(tmp_path / "kept"), 2019, mode=mode, run_up_days=run_up)

    write(inputs, path, inputs, YEARS)
    rows, built = run()
    assert built == list(YEARS) and same(rows, full(inputs, mode, run_up))
    assert run()[1] == []

    def check(name, year, change, expected):
        rest, own = inputs[name].filter(F.col("ano") != year), inputs[name].filter(F.col("ano") == year)
        inputs[name] = kept(rest.unionByName(change(own)), tmp_path)
        write(inputs, path, [name], [year])
        rows, built = run()
        assert built == expected
        assert same(rows, full(inputs, mode, run_up))

    # the lags of January, and of a region that begins the year late, read the year before
    check("climate", 2019, lambda t: t.withColumn("graus_refrig", F.col("graus_refrig") + 50), [2019, 2020])
    if mode == "linear":
        # the segments next to the year's anchors, two months later, and the annual change a year on
        check("monthly", 2018, lambda t: t.withColumn("industrial_mwh", F.col("industrial_mwh") * 2), [2018, 2019, 2020])
        # shares come from 2019: all national rows
        check("load", 2019, lambda t: t.withColumn(LOAD, F.when(F.col(SUB) == "N", F.col(LOAD) * 4).otherwise(F.col(LOAD))),
              list(YEARS))
        # the series begins later, so 2019 has no annual change any more
        check("load", 2018, lambda t: t.filter(F.col(DAY) > "2018-06-30"), [2018, 2019])
        # a year of files is gone
        inputs.update({n: t.filter("ano < 2021") for n, t in inputs.items()})
        rows, built = run(range(2018, 2021))
        assert same(rows, full(inputs, mode, run_up)) and 2018 not in built
    else:
        check("load", 2020, lambda t: t.filter(F.dayofmonth(DAY) % 4 > 0).withColumn(LOAD, F.col(LOAD) * 3), [2020, 2021])


def test_no_load_is_an_error(spark, inputs, tmp_path):
    write({n: t.limit(0).withColumn("ano", F.lit(2020)) for n, t in inputs.items()}, str(tmp_path), inputs, [2020])
    empty = {n: Source({2020: f"{tmp_path}/{n}/2020"}, "*.parquet", lambda y, n=n: spark.read.parquet(f"{tmp_path}/{n}/2020"))
             for n in inputs}
    with pytest.raises(ValueError, match="no rows"):
        dataset_of_years(spark, empty, f"{tmp_path}/kept", 2019)
