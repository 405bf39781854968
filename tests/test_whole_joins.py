"""Joins over every line of every order."""

import re
from collections import defaultdict

import pytest

from corpuskiln.plans import relational_queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("lineitem", "orders", "customer", "part")}


def test_every_order_is_cited(spark, rows):
    brand, cited = {p.p_partkey: p.p_brand for p in rows["part"]}, defaultdict(set)
    for r in rows["lineitem"]:
        if r.l_partkey in brand:
            cited[r.l_orderkey].add(brand[r.l_partkey])
    key = lambda b: (int(re.search("[0-9]+", b)[0]), b)
    want = {(o, ", ".join(sorted(bs, key=key)), len(bs)) for o, bs in cited.items()}
    assert {tuple(r) for r in Q.citation_grouping(spark, DATA).collect()} == want and any(o % 10 for o, _, _ in want)


def test_every_line_is_joined(spark, rows):
    customer = {c.c_custkey for c in rows["customer"]}
    order = {o.o_orderkey for o in rows["orders"] if o.o_custkey in customer}
    want = sorted((r.l_orderkey, r.l_linenumber) for r in rows["lineitem"] if r.l_orderkey in order)
    got = Q.full_article_join(spark, DATA).collect()
    assert sorted((r.l_orderkey, r.l_linenumber) for r in got) == want and min(r.l_quantity for r in rows["lineitem"]) < 45
