"""Vectors in cells: an index that scores the cells near a question instead of all vectors.

Cells are the centres of a spherical k-means, fitted in rounds on a bounded sample (of
``PER_CELL`` vectors a cell, by hash): in each round tasks assign their vectors with one
matrix product a batch and send a sum a cell.  All vectors, not only the sample, are then
written with their cell, in folders of cells.  A search opens the folders of the cells
that its questions are nearest to, filters rows by their columns first, packs what is left
into blocks by cell, and multiplies each block by the questions that probe the cell.  Scores
are exact; only which cells are looked at is not.

How many cells are probed is found when the index is built: as many as it takes until the
vectors of a small sample find ``target`` of their true neighbours.  ``probes`` equal to the
number of cells is the exact search.

Defined cases: vectors are taken as they are (cosine for unit ones); null vectors are left
out; ties go to the smaller key; an empty table makes an index that finds nothing; a filter
that leaves fewer than k rows in the probed cells yields fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators.ranks import top_k
from corpuskiln.operators.search import vector_top_k
from corpuskiln.operators.textindex import apart
from corpuskiln.sources.tables import scratch, written

#: Vectors of a cell on average, and of the sample a cell; cells at most, and rounds; folders; vectors that tune the probes.
CELL, PER_CELL, MOST_CELLS, ROUNDS, FOLDERS, TUNED_ON = 256, 64, 16_384, 8, 64, 64
BLOCK, ASKED = 4096, 1024


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _nearest(m: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n centres of highest product with each row, nearest first; ties go to the smaller number."""
    sims = np.round(m @ centres.T, 9)
    return np.argsort(-sims, axis=1, kind="stable")[:, :n]


def _first(sample: DataFrame, key: str, n: int) -> list:
    """The n vectors of the least hashes. Those below a bound are sent, little more than n: a sorted limit would send n of each task."""
    rows, bound = sample.select(F.xxhash64(F.lit(13), F.col(key)).alias("h"), key, "v"), 1.2 * n / max(sample.count(), 1)
    while True:
        some = rows.filter(F.col("h") <= min(int((bound - 0.5) * 2.0**64), 2**63 - 1)).collect()
        if len(some) >= n or bound >= 1:
            return [r["v"] for r in sorted(some, key=lambda r: (r["h"], r[key]))[:n]]
        bound = 2 * bound


def _round(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres of the vectors nearest to each centre. A centre without vectors stays."""
    sent = sample.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS centres at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(sent.value)
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0))
                np.add.at(total, _nearest(m, sent.value)[:, 0], m)
        at = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["cell", "total"])

    parts = sample.mapInArrow(run, "cell int, total array<double>")
    sums = parts.select("cell", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.round(F.sum("x"), 6).alias("x"))
    out = centres.copy()
    for r in sums.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("total")).collect():  # one row a centre
        out[r["cell"]] = r["total"]
    return _unit(out)


def _assigned(rows: DataFrame, centres: np.ndarray, n: int, vector: str, into: str = "cell") -> DataFrame:
    """``rows`` with the numbers of the n nearest centres, one row each."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def cells(s: pd.Series) -> pd.Series:
        return pd.Series(list(_nearest(np.stack(s.to_numpy()).astype(np.float64), sent.value, n).astype(np.int32))) if len(s) else pd.Series([], dtype=object)

    return rows.withColumn(into, F.explode(cells(F.col(vector))))


@dataclass(frozen=True)
class CellIndex:
    """``rows``: the vectors' table with cell and folder; ``centres``: one row of the matrix a cell."""

    rows: DataFrame
    centres: np.ndarray
    key: str
    vector: str
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str = "embedding", cells: int | None = None, at: str | None = None, target: float = 0.95, k: int = 20) -> CellIndex:
        """Fits cells, writes all vectors with theirs below ``at``, and finds the number of probes."""
        spark = vectors.sparkSession
        at = at or scratch(spark, "cells")
        held = vectors.filter(F.col(vector).isNotNull())
        total = held.count()
        n = max(1, min(cells or -(-total // CELL), MOST_CELLS, total or 1))
        order = F.xxhash64(F.lit(11), F.col(key))
        share = min(1.0, 1.5 * n * PER_CELL / max(total, 1))  # hashes below a bound: no sort of all vectors
        some = held.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col(vector).cast("array<double>").alias("v"), key)
        sample = written(some, name="sample")
        first = _first(sample, key, n)  # n centres to begin with
        centres = _unit(np.array(first, np.float64)) if first else np.zeros((0, 1))
        for _ in range(ROUNDS if first else 0):
            centres = _round(sample.select("v"), centres)
        if not first:
            return cls(written(held.withColumns({"cell": F.lit(0), "folder": F.lit(0)}), f"{at}/rows", by=("folder",)), centres, key, vector, 0)
        placed = _assigned(held, centres, 1, vector).withColumn("folder", F.pmod("cell", F.lit(FOLDERS)).cast("int"))
        laid = placed.repartition("folder", F.pmod(F.floor(F.col("cell") / FOLDERS), F.lit(16))).sortWithinPartitions("folder", "cell")
        rows = written(laid, f"{at}/rows", by=("folder",))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{at}/centres")
        index = cls(rows, centres, key, vector, len(centres))
        return cls(rows, centres, key, vector, index.tuned(target, k))

    @classmethod
    def read(cls, spark: SparkSession, at: str, key: str, vector: str = "embedding", probes: int = 16) -> CellIndex:
        rows = spark.read.parquet(f"{at}/centres").orderBy("cell").collect()
        return cls(spark.read.parquet(f"{at}/rows"), np.array([r["centre"] for r in rows]), key, vector, min(probes, len(rows)))

    def tuned(self, target: float, k: int) -> int:
        """Probes that find ``target`` of the true k nearest of ``TUNED_ON`` vectors, by doubling."""
        order = [F.xxhash64(F.lit(17), F.col(self.key)), F.col(self.key)]
        asked = written(self.rows.orderBy(*order).limit(TUNED_ON).select(F.col(self.key).cast("long").alias("query_id"), self.vector), name="tuning")
        true = written(vector_top_k(asked, self.rows.select(self.key, self.vector), self.key, k, self.vector).select("query_id", self.key), name="true")
        probes, wanted = min(4, len(self.centres)), true.count()
        while probes < len(self.centres):
            found = self.search(asked, k, probes=probes).select("query_id", self.key)
            if true.join(found, ["query_id", self.key]).count() >= target * wanted:
                break
            probes = min(2 * probes, len(self.centres))
        return probes

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, vector, cell): the cells that each question looks at."""
        return _assigned(queries.select("query_id", self.vector).filter(F.col(self.vector).isNotNull()), self.centres, probes or self.probes, self.vector)

    def scanned(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, n_rows): how many vectors each question is compared with."""
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n"))
        return self.probed(queries, probes).join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n_rows"))

    def search(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, key, score, rank): the k nearest of those in the probed cells that ``where`` lets through."""
        key, vector = self.key, self.vector
        kind = dict(self.rows.dtypes)[key]
        if not len(self.centres):
            return top_k(self.rows.sparkSession.createDataFrame([], f"query_id long, {key} {kind}, score double"), "query_id", [F.col(key)], k)
        if (probes or self.probes) >= len(self.centres):  # all cells: each vector meets each question once, in blocks without cells
            return vector_top_k(queries, self.rows, key, k, vector, where)
        probed = written(self.probed(queries, probes), name="probed")
        wanted = probed.select("cell").distinct()
        folders = [r[0] for r in wanted.select(F.pmod("cell", F.lit(FOLDERS))).distinct().collect()]  # FOLDERS numbers at most
        pool = self.rows.filter(F.col("folder").isin(folders))
        pool = (pool.filter(where) if where is not None else pool).join(wanted, "cell", "left_semi")
        left = _blocks(pool.select("cell", F.col(key).alias("k"), F.col(vector).alias("v")), kind, BLOCK, "m")
        right = _blocks(probed.repartition("cell").sortWithinPartitions("cell").select("cell", F.col("query_id").alias("k"), F.col(vector).alias("v")), "long", ASKED, "q")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for keys, m, ids, q in zip(pdf["m_keys"], pdf["m"], pdf["q_keys"], pdf["q"]):
                    keys, ids = np.asarray(keys), np.asarray(ids)
                    scores = np.round(np.frombuffer(q).reshape(len(ids), -1) @ np.frombuffer(m).reshape(len(keys), -1).T, 6)
                    n = min(k, len(keys))
                    kth = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
                    row, at = np.nonzero(scores >= kth[:, None])  # ties at the k-th place are settled by key below
                    yield pd.DataFrame({"query_id": ids[row], key: keys[at], "score": scores[row, at]})

        # repeated vectors take little room in files: by these, Spark would broadcast what questions send to all their cells
        found = apart(left).join(right, "cell").select("m_keys", "m", "q_keys", "q").mapInPandas(run, f"query_id long, {key} {kind}, score double")
        return top_k(found, "query_id", [F.col("score").desc(), F.col(key)], k)


def _blocks(rows: DataFrame, kind: str, most: int, name: str) -> DataFrame:
    """(cell, keys, matrix) of rows (cell, k, v): runs of a cell in a batch as one matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, mine in pdf.groupby("cell", sort=False):
                for at in range(0, len(mine), most):
                    part = mine.iloc[at : at + most]
                    yield pd.DataFrame({"cell": [cell], f"{name}_keys": [part["k"].tolist()], name: [np.stack(part["v"].to_numpy()).astype(np.float64).tobytes()]})

    return rows.mapInPandas(run, f"cell int, {name}_keys array<{kind}>, {name} binary")
