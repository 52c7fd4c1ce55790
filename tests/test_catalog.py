"""Catalog queries against DuckDB: all that have SQL."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from leadcurve.catalog.oracle import ORACLE
from leadcurve.catalog.queries import QUERIES
from leadcurve.session import stage

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.columns, rows) == canon(columns, result.fetchall())


def test_entry_runs(spark):
    assert entry(spark).count() == 6


def test_every_query_but_training_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"train_gbt"}


def test_backtest_queries_take_every_route(spark):
    routes = {r.route for r in QUERIES["period_slice"](spark, SF).filter("period = 'test'").select("route").distinct().collect()}
    assert len(routes) == 12
    decided = stage(QUERIES["simulate_decisions"](spark, SF), "decided")
    assert {r.route for r in decided.select("route").distinct().collect()} == routes
    assert {r.route for r in QUERIES["decision_candidates"](spark, SF).select("route").distinct().collect()} == routes
    assert {r.booking_decisions for r in QUERIES["full_backtest"](spark, SF).collect()} == {decided.count()}
