"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = entry.core


def cell(v):
    return "" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE.SQL))
def test_query_equals_sql(spark, duck, name):
    got = CORE.QUERIES[name](spark, SF)
    cursor = duck.execute(CORE.SQL[name])
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    want = sorted(tuple(cell(v) for v in (dict(zip(names, r)).get(c) for c in order)) for r in cursor.fetchall())
    assert sorted(got.columns) == order
    assert sorted(tuple(cell(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(CORE.QUERIES) - set(CORE.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert CORE.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
