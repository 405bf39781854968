"""Loading and small fixed query sets of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators.textindex import TextIndex
from corpuskiln.operators.vectorindex import CellIndex

#: (query_id, wording) of the standing query set.
ASKED = (
    (1, "apache license version"),
    (2, "released under the mit license"),
    (3, "general public license work"),
    (4, "the erth und de la"),
    (5, "pathetic worthless trash"),
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def asked(spark: SparkSession, rows: tuple = ASKED) -> DataFrame:
    rows = ", ".join(f"({i}L, '{q}')" for i, q in rows)  # a local relation: its size is known to the optimizer
    return spark.sql(f"SELECT * FROM VALUES {rows} AS q(query_id, query)")


def asked_sql(rows: tuple = ASKED) -> str:
    return "(VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in rows) + ") AS q(query_id, query)"


def terms_sql(alias: str = "terms", rows: tuple = ASKED) -> str:
    """The standing queries with their distinct tokens."""
    return f"(SELECT query_id, query, list_distinct(string_split(query, ' ')) AS {alias} FROM {asked_sql(rows)})"


_INDEXES: dict[tuple[str, str, str], TextIndex | CellIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the documents' texts, with language and source as title; written once per session."""
    docs = load(spark, sf_dir, "documents").withColumn("title", F.concat_ws(" ", "lang", "source"))
    return _once(spark, sf_dir, "words", lambda: TextIndex.build(docs, "doc_id", "text", "title"))


def cell_index(spark: SparkSession, sf_dir: str) -> CellIndex:
    return _once(spark, sf_dir, "cells", lambda: CellIndex.build(load(spark, sf_dir, "embeddings"), "vec_id"))


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _INDEXES:
        _INDEXES[at] = build()
    return _INDEXES[at]
