"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.jobs import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["customer", "orders", "events", "documents", "embeddings", "pages", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def lines(frame, columns):
    clean = frame[columns].astype(object)
    return sorted(str(r) for r in clean.where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    wanted = duck.sql(registry.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert lines(found, columns) == lines(wanted, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
