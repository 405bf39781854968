"""Files to corpus tables: read, clean, parse, label, chunk, embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import legal as G
from corpuskiln.functions import text as X
from corpuskiln.operators import layers as L
from corpuskiln.operators import providers, structure
from corpuskiln.sources import files
from corpuskiln.sources.buckets import Buckets
from corpuskiln.sources.tables import exists, written


def documents_of(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable) of binary files. Ids are hashes of paths, so a rerun finds the same ones.

    Files are opened once: their texts are written before anything is made of them. The text is cleaned but not rebuilt from
    its article blocks (``X.preprocessed``), which would lose what stands above the first article: number, dates and the
    heading of the first chapter."""
    read = written(files.texts(raw), name="texts")
    stem = G.file_stem(F.col("path"))
    good = read.filter("error IS NULL").withColumn("text", X.cleaned(X.composed("text"))).withColumn("doc_number", G.document_number(stem, F.col("text")))
    good = good.withColumn("document_type", G.document_kind(F.col("doc_number"), stem, F.col("text"))).withColumn("abstract", G.subject(F.col("text"), F.col("document_type")))
    issued = G.issued_date(F.col("text"))
    title = G.canonical_title(F.col("document_type"), F.col("doc_number"), issued, F.col("abstract"))
    docs = good.select(
        F.xxhash64("path").alias("document_id"), "path", "doc_number", "document_type", "abstract", issued.alias("issued_date"), G.effective_date(F.col("text")).alias("effective_date"),
        F.coalesce(title, stem).alias("title"), X.year_in("doc_number").alias("year"), "text",
    )
    return written(docs, name="documents"), read.filter("error IS NOT NULL").select(F.xxhash64("path").alias("document_id"), F.col("error").alias("reason"))


def corpus_tables(raw: DataFrame, patterns: structure.Patterns = structure.Patterns(), embedder: providers.Embedder | None = None, vocabulary: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """documents, chapters, sections, articles, clauses, chunk_vectors and ingest_errors. With a ``vocabulary``
    (domain -> keywords) documents get their domains, the first of which is ``legal_domain``.

    Texts, lines, articles and clauses are written as they are made (in the shared folder), so no table's plan parses anything again."""
    docs, unreadable = documents_of(raw)
    tables = structure.linked(structure.parsed(docs, patterns, written))
    good = docs.join(tables["errors"], "document_id", "left_anti")
    if vocabulary:
        labels = L.document_labels(L.domain_hits(F.concat_ws(" ", "title", F.substring("text", 1, 2500)), vocabulary, n=9))
        good = good.withColumn("law_intents", labels).withColumn("legal_domain", F.get("law_intents", F.lit(0)))
    payload = good.select("document_id", "doc_number", F.col("title").alias("document_title"), "document_type", "year")
    vectors = providers.embedded(tables["chunks"].join(payload, "document_id"), provider=embedder)
    return {"documents": good, "chapters": tables["chapters"], "sections": tables["sections"], "articles": tables["articles"], "clauses": tables["clauses"], "chunk_vectors": vectors, "ingest_errors": tables["errors"].unionByName(unreadable)}


def ingested(raw: DataFrame, store: Buckets, **options) -> list[int]:
    """The files' documents in the store: rows of files that were there before are replaced in all tables, and a file that
    can't be read any more leaves only its error. The buckets that were written are returned."""
    tables = corpus_tables(raw, **options)
    return store.replace(tables, raw.select(F.xxhash64("path").alias("document_id")))


def reembedded(vectors: DataFrame, embedder: providers.Embedder) -> DataFrame:
    """The same chunks with another model's vectors: one partitioned pass, no pages to keep track of."""
    return providers.embedded(vectors.drop("embedding"), provider=embedder)


def text_hash(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit(" ")))


def embedded_once(chunks: DataFrame, at: str, model: str, embedder: providers.Embedder, shards: int = 16) -> tuple[DataFrame, int]:
    """(chunks with their vectors, texts embedded): vectors are kept below ``at`` by model and hash of the text, and only
    texts without one are embedded, each once however many chunks have it.

    Unseen texts are embedded shard by shard (by the hash's beginning), each written when done: a run that stops is taken
    up where it was, and a run over an unchanged corpus embeds nothing."""
    spark = chunks.sparkSession
    path = f"{at.rstrip('/')}/model={model}"
    schema = "hash string, embedding array<float>, shard int"
    kept = lambda: spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    shard = F.pmod(F.conv(F.substring("hash", 1, 4), 16, 10).cast("int"), F.lit(shards))
    asked = chunks.select(text_hash().alias("hash"), F.coalesce("text", F.lit(" ")).alias("text")).groupBy("hash").agg(F.first("text").alias("text"))
    unseen = written(asked.join(kept().select("hash"), "hash", "left_anti").withColumn("shard", shard), name="unseen", by=("shard",))
    todo = {r["shard"]: r["count"] for r in unseen.groupBy("shard").count().collect()}
    for s in sorted(todo):
        new = providers.embedded(unseen.filter(F.col("shard") == s), provider=embedder).select("hash", "embedding", "shard")
        new.write.mode("append").partitionBy("shard").parquet(path)
    vectors = kept().groupBy("hash").agg(F.first("embedding").alias("embedding"))  # a shard that was written twice by a retry counts once
    return chunks.drop("embedding").withColumn("_hash", text_hash()).join(vectors.withColumnRenamed("hash", "_hash"), "_hash").drop("_hash"), sum(todo.values())
