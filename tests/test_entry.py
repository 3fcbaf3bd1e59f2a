"""The registry and its oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import check

TABLES = check.TABLES
NO_MODEL = sorted(contract.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "mae" in df.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NO_MODEL)
def test_query_equals_oracle(spark, con, sf, name):
    _, problems = check.compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], sf)
    assert not problems
