"""Hourly station files: a preamble, a header line and semicolon-separated readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.text import label_upper, station_date
from loadcast.schema import (DAY, SENSOR_HEADER_PREFIXES, SENSOR_MISSING_CODES, SENSORS, STATION,
                             STATION_REGION_TO_SUB)

# fixed values: layout of a station file
PREAMBLE_LINES = 8
REGION_LINE = 1
CODE_LINE = 4
MISSING_NUMBER = -9999.0


def header_position(header: Column, prefix: str) -> Column:
    """1-based position of the first header cell that starts with a prefix; 0 if there is none."""
    return F.array_position(F.transform(header, lambda h: label_upper(h).startswith(prefix)), True)


def sensor_number(cell: Column) -> Column:
    """Decimal-comma number; blank cells and missing codes are null."""
    cell = F.trim(cell)
    number = F.replace(cell, F.lit(","), F.lit(".")).try_cast("double")
    missing = cell.isin(list(SENSOR_MISSING_CODES)) | (number == MISSING_NUMBER) | F.isnan(number)
    return F.when(~missing, number)


def read_stations(spark: SparkSession, path: str | list[str], glob: str = "*.CSV") -> DataFrame:
    """Readings (arquivo, estacao, regiao_estacao, day, sensors) of every usable file.

    Files are read as lines, a large one in as many splits as its size asks for. Lines of a split are numbered one after the
    other, so the preamble and header are the least numbers of a file's first split (which has to hold them); they become
    one row a file, joined back to the lines. Latin-1 text is decoded explicitly. A file without a known region or without
    temperature and humidity is skipped; an optional sensor the file lacks is null.
    """
    raw = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
           .select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("inicio"),
                   F.monotonically_increasing_id().alias("ordem"), "value"))
    first = raw.filter("inicio").groupBy("path").agg(F.min("ordem").alias("primeira"))
    head = (raw.filter("inicio").join(first, "path").filter(F.col("ordem") <= F.col("primeira") + PREAMBLE_LINES)
            .groupBy("path", "primeira").agg(F.array_sort(F.collect_list(F.struct("ordem", "value"))).alias("head")))
    lines = F.transform("head.value", lambda line: F.decode(line.cast("binary"), "ISO-8859-1"))
    second = lambda line: F.trim(F.try_element_at(F.split(F.try_element_at("lines", F.lit(line)), ";"), F.lit(2)))
    parsed = head.select("path", "primeira", lines.alias("lines")).select(
        "path", "primeira", F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("arquivo"),
        F.upper(second(REGION_LINE)).alias("regiao_estacao"), second(CODE_LINE).alias(STATION),
        F.split(F.try_element_at("lines", F.lit(PREAMBLE_LINES + 1)), ";").alias("header"))
    where = {s: f"pos_{s}" for s in SENSORS}
    parsed = parsed.withColumns({
        where[short]: header_position(F.col("header"), prefix)
        for prefix, short in SENSOR_HEADER_PREFIXES.items()})
    usable = parsed.filter(F.col("regiao_estacao").isin(list(STATION_REGION_TO_SUB))
                           & F.col(STATION).isNotNull()
                           & (F.col("pos_temp") > 0) & (F.col("pos_umid") > 0))
    usable = usable.select("path", "primeira", "arquivo", "regiao_estacao", STATION, *where.values())
    body = raw.join(usable, "path").filter(~F.col("inicio") | (F.col("ordem") > F.col("primeira") + PREAMBLE_LINES))
    cells = body.withColumn("cells", F.split("value", ";"))
    reading = lambda s: F.when(F.col(where[s]) > 0, sensor_number(
        F.try_element_at("cells", F.greatest(F.col(where[s]).cast("int"), F.lit(1)))))
    return (cells.select("arquivo", "regiao_estacao", STATION,
                         station_date(F.try_element_at("cells", F.lit(1))).alias(DAY),
                         *[reading(s).alias(s) for s in SENSORS])
            .filter(F.col(DAY).isNotNull()))
