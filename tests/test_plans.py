"""Every plan with a SQL twin against DuckDB, and the entry module's shape."""

import duckdb
import pytest

import __spark_entry__
from plotwright.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([value(v) for v in r]) for r in zip(*(table[n].to_pylist() for n in names)))


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, sf, con, name):
    found, want = QUERIES[name](spark, sf).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(want.column_names)
    assert rows(found) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
