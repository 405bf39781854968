"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from corpuskiln.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else f"{value:.6g}"
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = tables.sql(registry.ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    left = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    right = sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "doc_id", "source", "final_score", "rank"] and out.count() > 0


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
