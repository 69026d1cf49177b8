"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from typeaudit import session
from typeaudit.plans import derived, oracle, queries

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")

QUERIES, SQL = queries.REGISTRY, oracle.statements()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in derived.SCHEMAS:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(frame):
    frame = frame[sorted(frame.columns)]
    cells = [tuple("NULL" if v is None or v != v else str(v) for v in row) for row in frame.itertuples(index=False)]
    return list(frame.columns), sorted(cells)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    ours = comparable(QUERIES[name](spark, SF_DIR).toPandas())
    assert ours == comparable(database.execute(SQL[name]).df())


def test_entry_is_not_empty(spark):
    assert entry_point.entry(spark).count() > 0


def test_shared_dir_is_the_configured_one(spark):
    folder = session.shared_dir(spark)
    assert folder == session.shared_dir(spark) and session.new_shared_path(spark, "x").startswith(folder)
