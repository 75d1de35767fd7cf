"""Every registered query on the smallest tables, against its SQL twin where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rounded(value):
    return float(f"{value:.10g}") if isinstance(value, float) else value


def kinds(columns, rows):
    return {c: {type(r[i]).__name__ for r in rows} - {"NoneType"} for i, c in enumerate(columns)}


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_matches_sql(spark, sql, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    rows = sorted((tuple(rounded(r[c]) for c in columns) for r in result.collect()), key=str)
    assert rows
    oracle = entry_points.oracle_sql().get(name)
    if oracle is not None:
        found = sql.execute(oracle)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        expected = sorted((tuple(rounded(r[i]) for i in order) for r in found.fetchall()), key=str)
        assert rows == expected
        assert kinds(columns, rows) == kinds(columns, expected)


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
