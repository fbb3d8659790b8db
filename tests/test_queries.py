"""Registered queries against their SQL at the smallest scale, where the driver's tables are there."""

from __future__ import annotations

import decimal
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def names():
    from tagloom.plans import catalog

    return sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from tagloom.plans import catalog

    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == columns
    want = sorted((tuple(plain(row[have.index(c)]) for c in columns) for row in cur.fetchall()), key=repr)
    assert got == want


def test_every_query_runs_on_its_tables():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
