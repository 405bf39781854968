"""Tables that change: upserts, deletes, caches, logs and conversations, as rewrites of DataFrames.

Parquet has no row updates, so a change is anti-join plus union; callers write
the result to a new version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.operators import ranks as R


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    return {name: t.join(ids.select(key).distinct(), key, "left_anti") if key in t.columns else t for name, t in tables.items()}


def checked_vectors(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Fails when a vector has another dimension."""
    return vectors.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, found "), F.size(vector).cast("string")))))


def cache_put(cache: DataFrame, answers: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """answers: query, answer, sources array<struct<document_id>>."""
    rows = answers.select(X.cache_key("query").alias("key"), "answer", "sources", (now + F.make_interval(secs=F.lit(ttl))).alias("expires_at"))
    return upsert(cache, rows, ["key"])


def cache_get(cache: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    live = cache.filter(F.col("expires_at") > now)
    return queries.withColumn("key", X.cache_key("query")).join(live, "key", "left")


def cache_drop(cache: DataFrame, document_id: int | None = None, query: str | None = None) -> DataFrame:
    """Without the entries of a query, of a document among the sources, or (neither given) of all."""
    if query is not None:
        return cache.filter(F.col("key") != X.cache_key(F.lit(query)))
    if document_id is not None:
        return cache.filter(~F.exists("sources", lambda s: s["document_id"] == document_id))
    return cache.limit(0)


def recent_logs(logs: DataFrame, n: int = 50) -> DataFrame:
    short = F.when(F.length("answer") > 200, F.concat(F.substring("answer", 1, 200), F.lit("..."))).otherwise(F.col("answer"))
    return logs.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(n).withColumn("answer", short)


def add_messages(messages: DataFrame, new: DataFrame, most: int = 100) -> DataFrame:
    return R.newest(messages.unionByName(new), "conversation_id", [F.col("message_id").desc()], most)


def history(messages: DataFrame, n: int = 20) -> DataFrame:
    return R.newest(messages, "conversation_id", [F.col("message_id").desc()], n).orderBy("conversation_id", "message_id")


def evict(conversations: DataFrame, capacity: int = 1000) -> DataFrame:
    return conversations.orderBy(F.col("created_at").desc(), F.col("conversation_id").desc()).limit(capacity)


def remembered(conversations: DataFrame, seen: DataFrame, keep: int = 5) -> DataFrame:
    """Appends documents to each conversation's history; the last ``keep`` stay."""
    new = seen.groupBy("conversation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "document"))), lambda x: x["document"]).alias("new"))
    every = F.concat(F.coalesce("document_history", F.array().cast("array<string>")), F.coalesce("new", F.array().cast("array<string>")))
    tail = F.when(F.size(every) > keep, F.slice(every, -keep, keep)).otherwise(every)
    return conversations.join(new, "conversation_id", "left").withColumn("document_history", tail).drop("new")


def follow_ups(queries: DataFrame, conversations: DataFrame, pattern: str) -> DataFrame:
    """Questions that lean on context get the conversation's last document appended."""
    last = F.element_at("document_history", -1)
    rows = queries.join(conversations.select("conversation_id", "document_history"), "conversation_id", "left")
    lean = F.rlike("query", F.lit(pattern)) & (F.size("document_history") > 0)
    return rows.withColumn("query", F.when(lean, F.concat_ws(" ", "query", F.concat(F.lit("("), last, F.lit(")")))).otherwise(F.col("query"))).drop("document_history")


def logged(logs: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with new entries (query, answer, documents, confidence, latency_ms, created_at); ids are hashes of the entry."""
    key = F.xxhash64("query", "answer", F.col("created_at").cast("string"))
    return logs.unionByName(entries.withColumn("log_id", key), allowMissingColumns=True)


def new_conversations(conversations: DataFrame, titles: DataFrame, now: Column) -> DataFrame:
    """Conversations with new ones (title): ids of 12 hex digits from title and time."""
    rows = titles.select(F.substring(F.sha2(F.concat_ws("|", "title", now.cast("string")), 256), 1, 12).alias("conversation_id"), "title", now.alias("created_at"), now.alias("updated_at"))
    return conversations.unionByName(rows, allowMissingColumns=True)


def merged_context(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Each conversation's context (map) with its changes (conversation_id, context): new keys replace old ones."""
    new = changes.select("conversation_id", F.col("context").alias("_new"))
    none = F.create_map().cast("map<string,string>")
    old = F.map_filter(F.coalesce("context", none), lambda k, v: ~F.map_contains_key(F.coalesce("_new", none), k))
    return conversations.join(new, "conversation_id", "left").withColumn("context", F.map_concat(old, F.coalesce("_new", none))).drop("_new")


def repaired_numbers(table: DataFrame, number: str = "doc_number") -> DataFrame:
    """A table with file-like numbers (45_2024_QH15_583769) in their clean form and ``repaired`` where one changed; run on
    documents and chunks alike."""
    parts = [F.regexp_extract(F.trim(number), r"^(\d+)[/_](\d{4})[/_]([A-Za-zĐđ][A-Za-zĐđ0-9\-]*)(?:_\d+)*$", i) for i in (1, 2, 3)]
    clean = F.when(parts[0] != "", F.concat_ws("/", *parts)).otherwise(F.col(number))
    return table.withColumn("repaired", F.coalesce(clean != F.col(number), F.lit(False))).withColumn(number, clean)


def report(tables: dict[str, DataFrame], path: str, rows: int = 50) -> str:
    """Writes each table as JSON below ``path`` and returns them as Markdown, the first ``rows`` of each."""
    out = []
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
        shown = [[str(v) for v in r] for r in table.limit(rows).collect()]
        out.append("\n".join([f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns), *("| " + " | ".join(r) + " |" for r in shown)]))
    return "\n\n".join(out) + "\n"


def with_columns(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (name -> type) of a table, null where an older version lacks one."""
    return table.select(*[F.col(c) if c in table.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def seeded_sample(table: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in an order that a seed fixes, whatever the layout."""
    return table.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
