"""A cross-section of the registered queries against their SQL on the smallest tables (tools/check.py runs all of them)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of
from tracewell.plans import ORACLES, QUERIES

SAMPLE = sorted(QUERIES)[::9]


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cursor = db.execute(ORACLES[name])
        assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
