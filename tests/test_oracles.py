"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from geotrail.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries that SQL can't express, with brute-force tests elsewhere.
WITHOUT_SQL = {"w5_integrate_in_order", "a5_a6_merge_by_radius"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(r) for r in got.select(cols).collect()]
    assert sorted(rows, key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
