"""User tables: dialects, aliases, regions, dates, numbers and rejects."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from loadcast.functions.text import label_lower, label_upper, localized_number, user_date
from loadcast.schema import DAY, SUB
from loadcast.sources.sinks import cached_years, publish, read_by_year, read_published, write_by_year, write_csv
from loadcast.sources import user_tables
from loadcast.sources.load import read_load
from loadcast.sources.user_tables import (BadInput, normalize_inputs, read_user_tables, region_code,
                                          rename_columns, strict_inputs, unknown_labels)


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_labels_are_folded(spark):
    assert one(spark, label_upper, "  Região\t Elétrica ") == ["REGIAO ELETRICA"]
    assert one(spark, label_lower, "Média", "MÁXIMA", "Média") == ["media", "maxima", "media"]


@pytest.mark.parametrize("label,code", [
    ("N", "N"), ("norte", "N"), ("Nordeste", "NE"), ("SUL", "S"), ("sudeste", "SE"),
    ("Sudeste/Centro-Oeste", "SE"), ("Centro-Oeste", "SE"), (" co ", "SE"), ("SIN", "SIN"),
    ("Brasil", "SIN"), ("nacional", "SIN"), ("Total", "SIN"), ("Sistema  Interligado Nacional", "SIN"),
    ("marte", None)])
def test_region_spellings(spark, label, code):
    assert one(spark, region_code, label) == [code]


def test_dates_are_day_first_and_iso_stays_iso(spark):
    got = one(spark, user_date, "05/03/2026", "5-3-2026", "2026-01-05", "2026-01-05 10:00:00", "2026/01/05",
              "31/02/2026", "29/02/2024", "29/02/2023", "13/13/2026", "amanha", "", None)
    assert got == [date(2026, 3, 5), date(2026, 3, 5), date(2026, 1, 5), date(2026, 1, 5), date(2026, 1, 5),
                   None, date(2024, 2, 29), None, None, None, None, None]


def test_numbers_drop_dots_only_next_to_a_comma(spark):
    assert one(spark, localized_number, "26.5", "26,5", "1.234,5", "x", "", None) == [26.5, 26.5, 1234.5, None, None, None]


def test_first_column_claims_the_alias(spark):
    df = spark.createDataFrame([("N", "01/02/2024", "1", "2")], "`Região` string, Data string, `Temperatura Média` string, temp string")
    renamed = rename_columns(df)
    assert renamed.columns[:3] == [SUB, DAY, "temp_mean"]
    assert normalize_inputs(df)[0].first().temp_mean == 1.0


def test_errors(spark):
    with pytest.raises(BadInput, match="missing column"):
        rename_columns(spark.createDataFrame([("N",)], "regiao string"))
    schema = "regiao string, data string"
    with pytest.raises(BadInput, match="marte"):
        strict_inputs(spark.createDataFrame([("marte", "01/02/2024")], schema))
    with pytest.raises(BadInput, match="1 row"):
        strict_inputs(spark.createDataFrame([("N", "nunca")], schema))
    with pytest.raises(BadInput, match="no rows"):
        strict_inputs(spark.createDataFrame([], schema))


def test_unknown_labels_are_few_distinct_and_sorted(spark):
    df = spark.createDataFrame([(f"z{i % 7}", "01/02/2024") for i in range(70)], "regiao string, data string")
    assert [r[0] for r in unknown_labels(normalize_inputs(df)[1]).collect()] == ["z0", "z1", "z2", "z3", "z4"]


def test_folder_of_dialects(spark, tmp_path):
    body = [["Região", "Data", "Temperatura"], ["Nordeste", "05/03/2026", "26,5"], ["Sul", "06/03/2026", "1.018,25"]]
    (tmp_path / "semi.csv").write_bytes("\r\n".join(";".join(r) for r in body).encode("latin-1"))
    (tmp_path / "tab.tsv").write_bytes("\n".join("\t".join(r) for r in body).encode("utf-8-sig"))
    comma = [[f'"{c}"' for c in r] for r in body]
    (tmp_path / "comma.txt").write_bytes("\n".join(",".join(r) for r in comma).encode())
    (tmp_path / "doc.pdf").write_bytes(b"%PDF")
    (tmp_path / "empty.csv").write_bytes(b"\n \n")
    (tmp_path / "zero bytes+1.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"regiao;data\n")
    (tmp_path / "narrow.csv").write_bytes(b"regiao\nN\n")
    (tmp_path / "nodate.csv").write_bytes(b"regiao;valor\nN;1\n")
    (tmp_path / "badregion.csv").write_bytes(b"regiao;data\nmarte;01/02/2024\nN;01/02/2024\n")
    accepted, rejected = read_user_tables(spark, str(tmp_path))
    got = {(r.arquivo, r[SUB], r[DAY], r.temp_mean) for r in accepted.collect()}
    assert got == {(f, s, d, t) for f in ("semi.csv", "tab.tsv", "comma.txt")
                   for s, d, t in (("NE", date(2026, 3, 5), 26.5), ("S", date(2026, 3, 6), 1018.25))}
    assert {r.arquivo: r.motivo for r in rejected.collect()} == {
        "doc.pdf": "extension", "empty.csv": "empty", "zero bytes+1.csv": "empty", "header.csv": "empty", "narrow.csv": "dialect",
        "nodate.csv": "missing_column", "badregion.csv": "unknown_region"}


def test_load_scan_keeps_known_subsystems(spark, tmp_path):
    (tmp_path / "2024.csv").write_text("id_subsistema;nom_subsistema;din_instante;val_cargaenergiamwmed\n"
                                       "N;Norte;2024-01-01;7000.5\nXX;?;2024-01-01;1\n")
    (tmp_path / "2025.csv").write_text("id_subsistema;nom_subsistema;din_instante;val_cargaenergiamwmed\n"
                                       "SE;Sudeste;2025-01-01 00:00:00;45000\n")
    got = read_load(spark, [str(tmp_path / "2024.csv"), str(tmp_path / "2025.csv")]).collect()
    assert sorted((r[0], r[2], r[3]) for r in got) == [("N", date(2024, 1, 1), 7000.5), ("SE", date(2025, 1, 1), 45000.0)]


def test_year_partitions_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2024), (2, 2025)], "x int, ano int")
    write_by_year(df, path)
    write_by_year(spark.createDataFrame([(9, 2025)], "x int, ano int"), path)
    assert sorted((r.x, r.ano) for r in read_by_year(spark, path).collect()) == [(1, 2024), (9, 2025)]
    assert [r.x for r in read_by_year(spark, path, [2024]).collect()] == [1]


def test_years_are_built_again_when_their_files_change(spark, tmp_path):
    cache, folders = str(tmp_path / "c"), {}
    for year in (2023, 2024, 2025):
        folder = tmp_path / f"in{year}"
        folder.mkdir()
        (folder / "a.txt").write_text(f"{year}\n")
        folders[year] = str(folder)

    def run(use_cache=True):
        build = lambda year: spark.read.text(folders[year]).withColumnRenamed("value", "x")
        years = cached_years(spark, cache, folders, "*.txt", build, use_cache)
        return years, sorted((r.ano, r.x) for r in read_by_year(spark, cache, list(folders)).collect())

    rows = [(2023, "2023"), (2024, "2024"), (2025, "2025")]
    assert run() == ([2023, 2024, 2025], rows) and run() == ([], rows)
    (tmp_path / "in2024" / "a.txt").write_text("2024\nmore\n")
    rows.insert(2, (2024, "more"))
    assert run() == ([2024], rows)
    (tmp_path / "in2025" / "b.txt").write_text("b\n")
    rows.append((2025, "b"))
    assert run() == ([2025], rows)
    (tmp_path / "in2025" / "b.txt").unlink()
    assert run() == ([2025], rows[:-1])
    assert run(use_cache=False) == ([2023, 2024, 2025], rows[:-1])


def test_published_tables_change_together(spark, tmp_path):
    root, one, two = str(tmp_path / "r"), spark.range(3), spark.range(5)
    with pytest.raises(FileNotFoundError):
        read_published(spark, root, "a")
    publish(spark, {"a": one, "b": one}, root)
    with pytest.raises(Exception, match="broken"):
        publish(spark, {"a": two, "b": two.select(F.raise_error(F.lit("broken")).alias("id"))}, root)
    assert [read_published(spark, root, n).count() for n in "ab"] == [3, 3]
    publish(spark, {"a": two, "b": two}, root)
    assert [read_published(spark, root, n).count() for n in "ab"] == [5, 5]


def test_brazilian_csv(spark, tmp_path):
    path = str(tmp_path / "o")
    write_csv(spark.createDataFrame([("N", 1.5, 2)], "a string, b double, c int").coalesce(1), path, brazilian=True)
    text = next((tmp_path / "o").glob("*.csv")).read_text()
    assert text == "a;b;c\nN;1,5;2\n"


def test_quoted_line_breaks_over_small_splits(spark, tmp_path):
    """Records of many lines, cut by splits of 64 bytes, equal those of Python's csv module."""
    import csv
    import random
    rng, want = random.Random(4), []
    for name, sep, code in (("a.csv", ";", "utf-8"), ("b.csv", ",", "latin-1")):
        rows = [["regiao", "nota", "data", "temperatura"]]
        for k in range(120):
            note = "".join(rng.choice(['"', "\n", sep, "é", "x", " ", "\n\n"]) for _ in range(rng.randrange(9)))
            rows.append([rng.choice(["N", "NE", "S", "SE"]), note, f"{k % 28 + 1:02d}/03/2024", str(k)])
        with open(tmp_path / name, "w", encoding=code, newline="") as out:
            csv.writer(out, delimiter=sep, lineterminator="\n").writerows(rows)
        want += [(name, r[0], date(2024, 3, int(r[2][:2])), float(r[3])) for r in rows[1:]]
    (tmp_path / "open.csv").write_text('regiao;data\nN;"01/01/2024\nS;02/01/2024\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        records, _ = user_tables.read_records(spark, str(tmp_path))
        assert records.filter("path like '%a.csv'").agg(F.max("linha"), F.count("*")).first() == (120, 121)
        accepted, rejected = user_tables.read_user_tables(spark, str(tmp_path))
        got = sorted((r.arquivo, r[SUB], r[DAY], r.temp_mean) for r in accepted.collect())
        assert [(r.arquivo, r.motivo) for r in rejected.collect()] == [("open.csv", "quotes")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(want)
