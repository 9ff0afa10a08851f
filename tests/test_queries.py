"""Every registered query beside its SQL on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(NAMES) and len(NAMES) > 170


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    got = check.rows_of(df.columns, rows)
    if name not in entry.oracle_sql():
        assert rows
        return
    result = con.execute(entry.oracle_sql()[name])
    assert got == check.rows_of([c[0] for c in result.description], result.fetchall())
