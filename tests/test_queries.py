"""Registered queries against their SQL on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from papersheaf.plans import oracles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in check.TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, database, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert check.compare(got, database.execute(entry.oracle_sql()[name]).df()).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns[:6] == [
        "document_name", "cluster_id", "size", "percentage", "avg_distance_to_center", "intra_cluster_similarity",
    ]
    assert found.count() > 0
