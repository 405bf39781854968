"""The corpus pipeline: toxic documents out, one of each group of near copies
kept, contaminated documents out, sources mixed, shards assigned.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on;
all but the last return the columns they were given.  Stages keep rows with
null ids or texts where their rule doesn't reject them: such rows are not
toxic by default, are never near copies of anything when they have no words,
and hold no benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm import jaccard, mixing, sharding, tiling, toxicity
from corpuskiln.llm.common import columns, fresh, load, row_key, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic. It learns from the
    labelled documents of the corpus, by the rule of the operator."""
    machine = toxicity.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    score, predicted = fresh(docs, "score", "predicted")
    return toxicity.score(docs, machine, (score, predicted)).filter(F.col(predicted) == 0).select(*columns(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, the one of the least id (null last), then of the least key, and one
    of rows equal in id and text. Rows without words, which have no shingles, all stay."""
    (key,) = fresh(docs, "key")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    chosen = jaccard.similar(docs).filter("cls IS NOT NULL").groupBy("comp").agg(F.min(order)["key"].alias(key)).select(key)
    worded = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    single = docs.filter(worded).withColumn(key, row_key()).dropDuplicates([key]).join(chosen, key, "left_semi")
    return single.select(*columns(docs)).unionByName(docs.filter(~worded))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once or twice)."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Models, tilings and balanced samples aren't SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
