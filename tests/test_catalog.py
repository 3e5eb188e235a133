"""Registered queries and their oracles fit together; results at the smallest sample agree."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from tocsin.plans import catalog, oracle

TABLES = ("events", "customer")


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.oracles())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    alerts = entry.entry(spark)
    assert alerts.filter("type = 'parent'").count() == 37 and alerts.count() == 44


@pytest.mark.parametrize(
    "name", ["alerts_final", "event_outcomes", "notifications", "routed_asof", "decoded_log"]
)
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert got == sorted(map(repr, result.fetchall()))
