"""Demand, climate and activity tables derived from the star-schema test tables.

Every view reads its whole source table. Amounts are summed as whole numbers, so sums are exact and
do not depend on the order in which partial results meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.text import lookup
from loadcast.operators.climate import map_station_region, regional_climate, station_day
from loadcast.operators.grid import climatology, region_medians
from loadcast.plans.dataset import build_dataset
from loadcast.schema import DAY, LOAD, STATION, SUB
from loadcast.session import STORE

TRAIN_YEAR = 1999
TEST_YEAR = 2000
# irrational steps, so that no mean sits exactly between two rounded values
DEGREES_PER_UNIT = 0.5772156649015329
HUMIDITY_PER_CENT = 4.71238898038469
WIND_PER_CENT = 0.915965594177219
REGION_CODES = {"AFRICA": "N", "ASIA": "NE", "EUROPE": "S", "AMERICA": "SE", "MIDDLE EAST": "CO"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def nation_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to subsystem, mapped once per nation. Spark broadcasts it after checking its size."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    coded = (nation.join(region, nation.n_regionkey == region.r_regionkey)
             .select("n_nationkey", lookup(REGION_CODES, F.col("r_name")).alias("regiao_estacao")))
    return map_station_region(coded)


def supplier_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to subsystem. Suppliers grow with the data, so the join strategy is left to Spark."""
    supplier, nations = read(spark, sf_dir, "supplier"), nation_subs(spark, sf_dir)
    return (supplier.join(nations, supplier.s_nationkey == nations.n_nationkey)
            .select(F.col("s_suppkey").alias(STATION), SUB))


def load_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily load per subsystem from orders.

    Orders are first folded per customer and day, on the map side. A customer then has at most one
    row per calendar day, so no customer key is hot in the join, however many orders it holds.
    """
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    nations = nation_subs(spark, sf_dir)
    folded = (orders.groupBy(F.col("o_custkey").alias("c_custkey"),
                             F.to_date("o_orderdate").alias(DAY))
              .agg(F.sum(F.round(F.col("o_totalprice") / 100).cast("long")).alias("total")))
    coded = (customer.join(nations, customer.c_nationkey == nations.n_nationkey)
             .select("c_custkey", SUB))
    return (folded.join(coded, "c_custkey")
            .groupBy(SUB, DAY).agg(F.sum("total").cast("double").alias(LOAD)))


def readings_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item read as one sensor reading of its supplier's station on its ship day."""
    item = read(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity")
    return item.select(
        F.col("l_suppkey").alias(STATION), F.to_date("l_shipdate").alias(DAY),
        (quantity * DEGREES_PER_UNIT + 15).alias("temp"),
        (cents(F.col("l_discount")) * HUMIDITY_PER_CENT + 40).alias("umid"),
        F.round(F.col("l_extendedprice") / 100).alias("rad"),
        (cents(F.col("l_tax")) * WIND_PER_CENT).alias("vento"),
        F.when(F.col("l_returnflag") == "R", quantity).alias("precip"))


def climate_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-days from line items, then the regional mean.

    The station-day aggregate runs before the supplier join for the same reason as above.
    """
    days = station_day(readings_from_lineitem(spark, sf_dir), [STATION], min_readings=1)
    return regional_climate(days.join(supplier_subs(spark, sf_dir), STATION))


def monthly_industrial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly activity per subsystem: line-item prices by ship month."""
    item = read(spark, sf_dir, "lineitem")
    ship = F.to_date("l_shipdate")
    folded = (item.groupBy(F.col("l_suppkey").alias(STATION), F.year(ship).alias("ano"),
                           F.month(ship).alias("mes"))
              .agg(F.sum(F.round("l_extendedprice").cast("long")).alias("total")))
    return folded.join(supplier_subs(spark, sf_dir), STATION).groupBy("ano", "mes", SUB).agg(F.sum("total").cast("double").alias("industrial_mwh"))


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as sensor readings of twelve stations; three source files per station."""
    events = read(spark, sf_dir, "events")
    station = (F.col("user_id") % 12).cast("int")
    code = F.element_at(F.array(*[F.lit(c) for c in ("N", "NE", "S", "SE", "CO")]), station % 5 + 1)
    value = F.round("value")
    return events.select(
        "event_id", F.to_date("ts").alias(DAY), station.alias(STATION),
        code.alias("regiao_estacao"), F.col("event_type").alias("arquivo"),
        (value / 2).alias("temp"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("umid"),
        (value * 10).alias("rad"), (value / 8).alias("vento"),
        F.when(F.col("event_type") == "error", value).alias("precip"))


def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a row of a user's spreadsheet: spelt-out region, text date, text number."""
    orders = read(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    labels = ["Norte", " NORDESTE ", "sul", "Sudeste/Centro-Oeste", "Centro-Oeste", "SIN", "Brasil",
              "ne", "Sudeste  e Centro-Oeste", "Região Única"]
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (key % 10 + 1).cast("int"))
    label = F.when(label == "Região Única", F.concat(label, F.lit(" "), F.col("o_orderpriority"))
                   ).otherwise(label)
    text_day = (F.when(key % 7 == 0, F.lit("31/02/1999"))
                .when(key % 2 == 0, F.date_format(day, "dd/MM/yyyy"))
                .otherwise(F.date_format(day, "yyyy-MM-dd")))
    whole = cents(F.col("o_totalprice"))
    units, hundredths = F.floor(whole / 100).cast("long"), whole % 100
    thousands = F.floor(units / 1000).cast("long")
    tail = F.concat(F.lpad((units % 1000).cast("string"), 3, "0"))
    local = F.concat(thousands.cast("string"), F.lit("."), tail, F.lit(","),
                     F.lpad(hundredths.cast("string"), 2, "0"))
    number = (F.when(key % 11 == 0, F.lit("n/d"))
              .when(key % 3 == 0, F.concat(units.cast("string"), F.lit("."),
                                           F.lpad(hundredths.cast("string"), 2, "0")))
              .otherwise(local))
    return orders.select("o_orderkey", label.alias("regiao"), text_day.alias("data"),
                         number.alias("temperatura"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly activity laid back into worksheet blocks, with decoy rows around them."""
    months = [f"c{m}" for m in range(1, 13)]
    labels = {"N": "Norte", "NE": "Nordeste", "SE": "Sudeste/C. Oeste", "S": "Sul"}
    wide = (industrial_table(spark, sf_dir).groupBy("ano", SUB)
            .pivot("mes", list(range(1, 13))).agg(F.first("industrial_mwh"))
            .toDF("ano", SUB, *months))
    blank = F.lit(None).cast("string")
    rank = F.element_at(F.create_map(*[x for i, s in enumerate(labels) for x in (F.lit(s), F.lit(i))]), F.col(SUB))
    def cells(values):
        return [v.cast("string").alias(c) for c, v in zip(months, values)]
    base = F.col("ano") * 100
    data = wide.select((base + 20 + rank).alias("row_no"), lookup(labels, F.col(SUB)).alias("c0"),
                       *cells([F.col(m) for m in months]))
    decoy = wide.select((base + 3 + rank).alias("row_no"), lookup(labels, F.col(SUB)).alias("c0"),
                        *cells([F.lit(1.0)] * 12))
    years = wide.select("ano").distinct()
    def row(offset, c0, values):
        return years.select((base + offset).alias("row_no"), c0.alias("c0"), *cells(values))
    parts = [
        row(0, blank, [F.concat(F.col("ano").cast("string"),
                                F.when(F.col("ano") % 2 == 0, "*").otherwise(""))] * 12),
        row(1, F.lit("TOTAL  POR  CLASSE"), [F.lit("9.0")] * 12),
        row(2, F.lit("Região Geográfica"), [blank] * 12),
        row(10, F.lit("Subsistema  Elétrico"), [blank] * 12),
        row(11, F.lit("Sistemas isolados"), [F.lit("7.0")] * 12),
        decoy,
    ]
    for part in parts:
        data = data.unionByName(part)
    return data.select(F.lit("INDUSTRIAL").alias("sheet"), "row_no", "c0", *months)


# Reduced tables, written once per application and read from then on.

def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STORE.table(spark, sf_dir, "load", lambda: load_by_region(spark, sf_dir))


def climate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STORE.table(spark, sf_dir, "climate", lambda: climate_by_region(spark, sf_dir))


def industrial_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STORE.table(spark, sf_dir, "industrial", lambda: monthly_industrial(spark, sf_dir))


def dataset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        return build_dataset(load_table(spark, sf_dir), climate_table(spark, sf_dir),
                             industrial_table(spark, sf_dir), TRAIN_YEAR)
    return STORE.table(spark, sf_dir, "dataset", build)


def medians_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STORE.table(spark, sf_dir, "medians", lambda: region_medians(dataset_table(spark, sf_dir)))


def normal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STORE.table(spark, sf_dir, "normal", lambda: climatology(dataset_table(spark, sf_dir)))


def year_rows(df: DataFrame, year: int) -> DataFrame:
    return df.filter(F.year(DAY) == year)


def all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions present in the dataset: four subsystems and the nation."""
    return dataset_table(spark, sf_dir).select(SUB).distinct()
