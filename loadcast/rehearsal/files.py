"""The test tables written out as input files, by the executors, for the queries that scan files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.text import decimal_comma
from loadcast.operators.climate import regional_climate, station_day
from loadcast.plans.dataset_job import Source
from loadcast.rehearsal import views as v
from loadcast.schema import DAY, LOAD, STATION, SUB, SUB_NAME, SUBSYSTEM_NAMES
from loadcast.session import STORE
from loadcast.sources.load import read_load
from loadcast.sources.user_tables import normalize_inputs

STATION_GLOB = "*.csv"
STATION_HEADER = ("Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);TEMPERATURA DO AR - BULBO SECO (°C);"
                  "UMIDADE RELATIVA DO AR (%);RADIACAO GLOBAL (Kj/m²);VENTO, VELOCIDADE HORARIA (m/s)")
#: folder, separator and encoding of the users' files
DIALECTS = [("semicolon", ";", "ISO-8859-1"), ("comma", ",", "UTF-8"), ("tab", "\t", "ISO-8859-1"), ("bar", "|", "UTF-8")]


def station_files(spark: SparkSession, sf: str) -> str:
    """All events as Latin-1 station files, one for each station and week: preamble, header, a line for each event.

    Whole lines go through the CSV sink without quotes, as the text sink writes UTF-8 only.
    """
    def write(path: str) -> None:
        rows = v.readings_from_events(spark, sf)
        sensor = lambda c: F.coalesce(decimal_comma(F.col(c)), F.lit(""))
        file = [F.year(DAY).alias("ano"), F.col(STATION), F.date_trunc("week", DAY).cast("date").alias("semana")]
        lines = rows.select(*file, (F.col("event_id") + 10).alias("linha"), F.concat_ws(
            ";", F.date_format(DAY, "yyyy/MM/dd"), F.lit("0000 UTC"), *map(sensor, ("precip", "temp", "umid", "rad", "vento"))
        ).alias("value"))
        preamble = [F.concat(F.lit("REGIAO:;"), F.col("regiao_estacao")), F.lit("UF:;XX"), F.lit("ESTACAO:;X"),
                    F.concat(F.lit("CODIGO (WMO):;"), F.col(STATION).cast("string")), *[F.lit("-:;0")] * 4,
                    F.lit(STATION_HEADER)]
        heads = rows.select(*file, "regiao_estacao").distinct().select(
            "ano", STATION, "semana", F.posexplode(F.array(*preamble)).alias("linha", "value"))
        keys = ["ano", STATION, "semana"]
        (heads.withColumn("linha", F.col("linha").cast("long")).unionByName(lines)
         .repartition(*keys).sortWithinPartitions(*keys, "linha").select(*keys, "value")
         .write.partitionBy(*keys).mode("overwrite").csv(path, sep="\t", quote="", encoding="ISO-8859-1"))
    return _once(spark, sf, "station-files", write)


def user_folder(spark: SparkSession, sf: str) -> str:
    """All orders as users' files in four dialects and two encodings, and files that cannot be used.

    A file is accepted or rejected as a whole, so rows with an unknown region and rows with a bad date have
    files of their own.
    """
    def write(path: str) -> None:
        rows = v.user_rows(spark, sf)
        _, rejected = normalize_inputs(rows)
        marked = rows.join(rejected.select("o_orderkey", "motivo"), "o_orderkey", "left")
        def save(part: DataFrame, folder: str, separator: str, encoding: str) -> None:
            # a note with quotes and a line break in every fifth row
            note = F.when(F.col("o_orderkey") % 5 == 0, f'ver "anexo"{separator}\ncontinua; aqui').otherwise("ok")
            (part.select("regiao", note.alias("nota"), "data", "temperatura", F.col("o_orderkey").alias("pedido"))
             .write.mode("overwrite").csv(f"{path}/{folder}", sep=separator, header=True, encoding=encoding, escape='"'))
        turn = F.pmod(F.xxhash64("o_orderkey"), F.lit(len(DIALECTS)))
        for i, dialect in enumerate(DIALECTS):
            save(marked.filter(F.col("motivo").isNull() & (turn == i)), *dialect)
        for reason in ("unknown_region", "bad_date"):
            save(marked.filter(F.col("motivo") == reason), reason, ";", "UTF-8")
        header = spark.createDataFrame([("regiao;data",)], "value string")
        header.coalesce(1).write.mode("overwrite").text(f"{path}/only-header")
        header.select(F.lit("regiao")).coalesce(1).write.mode("overwrite").text(f"{path}/narrow")
        header.select(F.explode(F.array(F.lit("regiao;valor"), F.lit("N;1")))).coalesce(1).write.mode(
            "overwrite").text(f"{path}/no-date")
        header.select(F.explode(F.array(F.lit("regiao;data;nota"), F.lit('N;1/1/2020;"aberta')))).coalesce(1).write.mode(
            "overwrite").text(f"{path}/open-quote")
        header.limit(0).coalesce(1).write.mode("overwrite").text(f"{path}/zero-bytes")
    return _once(spark, sf, "user-folder", write)


def write_load_year(rows: DataFrame, path: str, year: int) -> None:
    """One year's load file, as the source has it."""
    (rows.filter(F.year(DAY) == year).select(SUB, v.lookup(SUBSYSTEM_NAMES, F.col(SUB)).alias(SUB_NAME), DAY, LOAD)
     .coalesce(1).write.mode("overwrite").csv(f"{path}/load/ano={year}", sep=";", header=True))


def dataset_files(spark: SparkSession, sf: str) -> str:
    """A folder a year of load files, of readings (every line item) and of monthly industrial consumption."""
    def write(path: str) -> None:
        v.readings_from_lineitem(spark, sf).withColumn("ano", F.year(DAY)).write.partitionBy("ano").parquet(f"{path}/readings")
        v.industrial_table(spark, sf).write.partitionBy("ano").parquet(f"{path}/months")
        for year in years_of(v.load_table(spark, sf), F.year(DAY)):
            write_load_year(v.load_table(spark, sf), path, year)
    return _once(spark, sf, "dataset-files", write)


def years_of(rows: DataFrame, year) -> list[int]:
    """The calendar years of a table."""
    return sorted(r[0] for r in rows.select(year).distinct().collect())


def dataset_sources(spark: SparkSession, sf: str, path: str) -> dict[str, Source]:
    def climate(year: int) -> DataFrame:
        readings = spark.read.parquet(f"{path}/readings/ano={year}")
        return regional_climate(station_day(readings, [STATION], min_readings=1).join(v.supplier_subs(spark, sf), STATION))

    def folders(name: str, years: list[int]) -> dict[int, str]:
        return {y: f"{path}/{name}/ano={y}" for y in years}

    loads = years_of(v.load_table(spark, sf), F.year(DAY))
    months = years_of(v.industrial_table(spark, sf), F.col("ano"))      # readings and months have the same ship dates
    return {"load": Source(folders("load", loads), "*.csv", lambda y: read_load(spark, f"{path}/load/ano={y}").drop(SUB_NAME)),
            "climate": Source(folders("readings", months), "*.parquet", climate),
            "monthly": Source(folders("months", months), "*.parquet",
                              lambda y: spark.read.parquet(f"{path}/months/ano={y}"))}


def _once(spark: SparkSession, sf: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf, name)
    path = STORE.folder(spark, sf, name)
    if key not in _written:
        write(path)
        _written.add(key)
    return path


_written: set[tuple] = set()
