"""The index of cells against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.operators.search import vector_top_k
from corpuskiln.operators.vectorindex import CellIndex


def vectors(n=3000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(40, dim))
    m = near[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return [(i, [float(x) for x in np.float32(row)], i % 5) for i, row in enumerate(m)] + [(n, None, 0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def index(table):
    return CellIndex.build(table, "vec_id", cells=64)


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def asked(table):
    return table.filter("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding")


def test_recall_and_rows_scanned(table, index):
    true, found = pairs(vector_top_k(asked(table), table, "vec_id", 20)), pairs(index.search(asked(table), 20))
    assert len(true & found) >= 0.9 * len(true)
    rows = index.scanned(asked(table)).collect()
    assert len(rows) == 60 and sum(r["n_rows"] for r in rows) < 0.6 * 60 * 3000 and index.probes < len(index.centres)


def test_every_vector_is_in_one_cell(index):
    assert index.rows.count() == 3000 and index.rows.select("vec_id").distinct().count() == 3000


@pytest.mark.parametrize("labels", [None, (1, 3)])
def test_all_cells_are_the_exact_search(table, index, labels):
    where = F.col("label").isin(*labels) if labels else None
    exact = vector_top_k(asked(table), table, "vec_id", 7, where=where).collect()
    found = index.search(asked(table), 7, where, probes=len(index.centres)).collect()
    key = lambda r: (r["query_id"], r["rank"])
    assert [tuple(r) for r in sorted(found, key=key)] == [tuple(r) for r in sorted(exact, key=key)]


def test_a_search_opens_some_folders_only(table, index):
    one = asked(table).limit(1)
    plan = index.search(one, 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_index_is_read_again(spark, table, tmp_path):
    at = f"file://{tmp_path}/cells"
    built = CellIndex.build(table.filter("vec_id < 400"), "vec_id", cells=8, at=at)
    again = CellIndex.read(spark, at, "vec_id", probes=built.probes)
    assert pairs(again.search(asked(table), 5)) == pairs(built.search(asked(table), 5))


def test_few_and_no_vectors(spark, table):
    none = table.limit(0)
    assert CellIndex.build(none, "vec_id").search(asked(table), 5).count() == 0
    three = CellIndex.build(table.filter("vec_id < 3"), "vec_id", cells=9)
    assert three.search(asked(table), 5).groupBy("query_id").count().select("count").distinct().collect() == [(3,)]
