"""Station files: preamble, quality control, coverage, degree days and duplicates."""

from datetime import date

import pytest

from loadcast.operators.climate import (dedup_station_days, map_station_region, regional_climate,
                                        station_day)
from loadcast.operators.quality import keep_last, quality_control
from loadcast.schema import DAY, STATION, SUB
from loadcast.sources.stations import read_stations

HEADER = ("Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);Temperatura  do Ar - Bulbo Seco, Horaria (°C);"
          "UMIDADE RELATIVA DO AR, HORARIA (%);VENTO, VELOCIDADE HORARIA (m/s);")


def write_station(folder, name, region="N", code="A001", temp="25,0", hours=24, n_days=3, header=HEADER,
                  date_sep="/", humidity="80"):
    lines = [f"REGIAO:;{region}", "UF:;XX", "ESTACAO:;TESTE", f"CODIGO (WMO):;{code}", "LATITUDE:;0",
             "LONGITUDE:;0", "ALTITUDE:;0", "DATA DE FUNDACAO:;2000", header]
    for d in range(n_days):
        for h in range(hours):
            day = date_sep.join(["2024", "01", f"{d + 1:02d}"])
            lines.append(f"{day};{h:02d}00 UTC;,2;{temp};{humidity};2,0;")
    (folder / name).write_bytes("\r\n".join(lines).encode("latin-1"))


def daily(spark, folder):
    readings = map_station_region(quality_control(read_stations(spark, str(folder))))
    return station_day(readings, ["arquivo", STATION, SUB])


def test_reads_latin1_decimal_comma_and_headers_by_prefix(spark, tmp_path):
    write_station(tmp_path, "a.CSV")
    got = read_stations(spark, str(tmp_path)).collect()
    assert len(got) == 72
    r = got[0]
    assert (r.estacao, r.regiao_estacao, r.temp, r.umid, r.vento, r.precip) == ("A001", "N", 25.0, 80.0, 2.0, 0.2)
    assert r.rad is None
    assert {x[DAY] for x in got} == {date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)}


def test_centre_west_belongs_to_southeast(spark, tmp_path):
    write_station(tmp_path, "a.CSV", region="CO")
    assert {r[SUB] for r in daily(spark, tmp_path).collect()} == {"SE"}


def test_degree_days_and_hot_hours(spark, tmp_path):
    write_station(tmp_path, "a.CSV", temp="30,0")
    for r in daily(spark, tmp_path).collect():
        assert (r.graus_refrig, r.graus_aquec, r.horas_acima_26) == (8.0, 0.0, 24.0)


def test_thin_day_is_dropped(spark, tmp_path):
    write_station(tmp_path, "a.CSV", hours=6)
    assert daily(spark, tmp_path).count() == 0


@pytest.mark.parametrize("temp", ["999,0", "-9999", "", "abc"])
def test_broken_sensor_is_null(spark, tmp_path, temp):
    write_station(tmp_path, "a.CSV", temp=temp)
    readings = quality_control(read_stations(spark, str(tmp_path)))
    assert readings.filter("temp is not null").count() == 0 and readings.count() == 72


def test_unknown_region_and_missing_column_skip_the_file(spark, tmp_path):
    write_station(tmp_path, "a.CSV", region="XX")
    write_station(tmp_path, "b.CSV", header=HEADER.replace("UMIDADE", "OUTRA"))
    write_station(tmp_path, "c.CSV", code="A003", date_sep="-")
    assert {r[STATION] for r in read_stations(spark, str(tmp_path)).collect()} == {"A003"}


def test_duplicate_station_day_keeps_last_file(spark, tmp_path):
    write_station(tmp_path, "a.CSV", temp="20,0")
    write_station(tmp_path, "b.CSV", temp="28,0")
    kept = dedup_station_days(daily(spark, tmp_path))
    assert [(r.arquivo, r.temp_mean) for r in kept.collect()] == [("b.CSV", 28.0)] * 3
    assert [r.n_estacoes for r in regional_climate(kept).collect()] == [1.0] * 3


def test_regional_mean_averages_degree_days_not_temperature(spark, tmp_path):
    write_station(tmp_path, "a.CSV", code="A1", temp="30,0")
    write_station(tmp_path, "b.CSV", code="A2", temp="14,0")
    r = regional_climate(dedup_station_days(daily(spark, tmp_path))).first()
    assert (r.temp_mean, r.graus_refrig, r.graus_aquec, r.n_estacoes) == (22.0, 4.0, 2.0, 2.0)


def test_all_missing_sum_is_zero_and_missing_temperature_has_no_degrees(spark):
    df = spark.createDataFrame([("s", "N", date(2024, 1, 1), None, 50.0, None, None)],
                               f"{STATION} string, {SUB} string, {DAY} date, temp double, umid double, rad double, precip double")
    r = station_day(df, [STATION, SUB], min_readings=0).first()
    assert (r.rad_sum, r.precip_sum, r.graus_refrig, r.horas_acima_26) == (0.0, 0.0, None, 0.0)


def test_limits_are_inclusive_and_nan_is_missing(spark):
    df = spark.createDataFrame([(55.0,), (-15.0,), (55.1,), (float("nan"),), (None,)], "temp double")
    got = [r.temp for r in quality_control(df).collect()]
    assert got == [55.0, -15.0, None, None, None]


def test_keep_last_with_null_cells(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, 7.0)], "k string, o int, x double")
    assert sorted((r.k, r.x) for r in keep_last(df, ["k"], ["o"]).collect()) == [("a", None), ("b", 7.0)]


def test_one_station_with_most_readings(spark):
    """A hot station: partial aggregates give the same result as a plain group."""
    df = spark.range(60000).selectExpr("cast(if(id % 3 < 2, 0, id % 50) as int) estacao", "'N' id_subsistema",
                                       "date'2024-01-01' din_instante", "cast(id % 40 as double) temp", "50.0D umid")
    got = {r.estacao: r.temp_mean for r in station_day(df, [STATION, SUB]).collect()}
    want = {r.estacao: r.m for r in df.groupBy("estacao").agg({"temp": "avg"}).withColumnRenamed("avg(temp)", "m").collect()}
    assert got == pytest.approx(want)
