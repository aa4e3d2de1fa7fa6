"""Every registered query of the engine beside its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from shardloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    result = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["q25_p50", "q28_p99", "q28b_percentile_global"])
def test_percentiles_by_ranks(spark, duck, name, monkeypatch):
    """The way of large tables, on a small one."""
    monkeypatch.setattr("shardloom.functions.aggregates.SMALL_BYTES", 0)
    test_query(spark, duck, name)


def test_ordered_results_keep_their_order(spark):
    rows = [r.n for r in catalogue.QUERIES["q30_top_n"](spark, DIR).collect()]
    assert rows == sorted(rows, reverse=True)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
