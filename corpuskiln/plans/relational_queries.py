"""Registered queries of joins, filters, state tables and analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskiln.functions import rules as U
from corpuskiln.functions import text as X
from corpuskiln.operators import metrics as M
from corpuskiln.operators import ranks as R
from corpuskiln.plans.common import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@register("""SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment, coalesce(n_name, 'unknown') AS n_name, r_name, coalesce(s_name, p_name) AS label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey""")
def full_article_join(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    supplier = load(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name", "s_nationkey")
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    out = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    out = out.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", F.coalesce("n_name", F.lit("unknown")).alias("n_name"), "r_name", F.coalesce("s_name", "p_name").alias("label"))


@register("SELECT o_orderkey, o_orderstatus, o_totalprice, count(*) OVER () AS total FROM orders WHERE upper(trim(o_orderstatus)) = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def optional_filter_paging(spark, sf_dir, status: str | None = " f ", offset: int = 40, limit: int = 20):
    orders = load(spark, sf_dir, "orders")
    if status is not None:
        orders = orders.filter(F.upper(F.trim("o_orderstatus")) == status.strip().upper())
    total = orders.agg(F.count("*").alias("total"))
    page = orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).select("o_orderkey", "o_orderstatus", "o_totalprice", "total")


@register("SELECT c_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, row_number() OVER (ORDER BY max(o_orderdate) DESC NULLS LAST, c_custkey DESC) AS rank FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY rank LIMIT 50")
def nulls_last_recency(spark, sf_dir):
    latest = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    rows = load(spark, sf_dir, "customer").select("c_custkey").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    top = rows.orderBy(F.desc_nulls_last("at"), F.col("c_custkey").desc()).limit(50)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("at"), F.col("c_custkey").desc())).cast("long")  # over the 50 rows only
    return top.select("c_custkey", F.date_format("at", "yyyy-MM-dd").alias("latest"), rank.alias("rank"))


@register("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, '1') OR year(o_orderdate) = 1995 AND starts_with(upper(o_orderpriority), '2')")
def year_or_substring_filter(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.filter(F.contains("o_orderpriority", F.lit("1")) | ((F.year("o_orderdate") == 1995) & F.upper("o_orderpriority").startswith("2"))).select("o_orderkey", "o_orderpriority")


@register("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'under') AND lang IN ('en', 'fr')")
def all_terms_filter(spark, sf_dir):
    d = load(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr"))
    return d.filter(F.forall(F.array(F.lit("license"), F.lit("under")), lambda t: F.contains(F.lower("text"), t))).select("doc_id")


@register("SELECT event_id, nullif(lower(trim(event_type)), 'view') AS event_type FROM events")
def placeholder_cleanup(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.lower(F.trim(X.placeholder_to_null("event_type", ("view",)))).alias("event_type"))


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'order ' || o_orderkey FROM orders WHERE o_totalprice > 300000")
def missing_keys_synthesised(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    absent = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return absent.unionByName(o.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("c_name")))


@register("""WITH need(kind, items) AS (VALUES ('a', ['AUTOMOBILE', 'BUILDING', 'MACHINERY']), ('b', ['BUILDING', 'NOTHING'])), have AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_acctbal > 0)
SELECT kind, i AS item FROM (SELECT kind, unnest(items) AS i FROM need) WHERE i NOT IN (SELECT s FROM have)""")
def missing_items(spark, sf_dir):
    need = spark.sql("SELECT * FROM VALUES ('a', array('AUTOMOBILE', 'BUILDING', 'MACHINERY')), ('b', array('BUILDING', 'NOTHING')) AS n(kind, items)")
    have = load(spark, sf_dir, "customer").filter("c_acctbal > 0").agg(F.collect_set("c_mktsegment").alias("have"))  # a handful of segments
    return need.crossJoin(F.broadcast(have)).select("kind", F.explode(F.array_except("items", "have")).alias("item"))


@register("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_last_n(spark, sf_dir):
    return R.newest(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", [F.col("turn").desc()], 3)


@register("SELECT c.conv_id, count(t.turn)::BIGINT AS n_messages, count(t.turn) FILTER (t.role = 'user')::BIGINT AS n_user FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN conversations t USING (conv_id) GROUP BY c.conv_id")
def conversation_counts(spark, sf_dir):
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("turn").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"))


@register("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 100")
def trim_to_max(spark, sf_dir):
    return R.newest(load(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", [F.col("turn").desc()], 100)


@register("""WITH k AS (SELECT conv_id, turn, 'legal_chat:' || left(sha256(lower(trim(text))), 16) AS key FROM conversations WHERE role = 'user')
SELECT conv_id, turn, key, count(*) OVER (PARTITION BY key) > 1 AS repeated FROM k""")
def cache_key_hit(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", X.cache_key("text").alias("key"))
    again = rows.groupBy("key").agg((F.count("*") > 1).alias("repeated"))
    return rows.join(again, "key")


@register("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
def log_stats(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    means = e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_value"))
    return M.frequency(e, "event_type").join(means, "event_type")


_BUCKET = "CASE WHEN n_chars < 500 THEN '0-499' WHEN n_chars < 2000 THEN '500-1999' WHEN n_chars < 8000 THEN '2000-7999' ELSE '8000+' END"


@register(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY 1")
def bucket_histogram(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(X.length_bucket(F.col("n_chars"), (500, 2000, 8000)).alias("bucket")).agg(F.count("*").alias("n"))


@register(f"SELECT lang, {_BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY 1, 2")
def cross_tab(spark, sf_dir):
    return M.cross_tab(load(spark, sf_dir, "documents").select("lang", X.length_bucket(F.col("n_chars"), (500, 2000, 8000)).alias("bucket")), "lang", "bucket")


_PRED = "SELECT quality::VARCHAR AS gold, CASE WHEN n_chars < 600 THEN '0' ELSE '1' END AS predicted FROM labels JOIN documents USING (doc_id)"
_CLASS = f"""
WITH t AS (SELECT gold, predicted, count(*) AS n FROM ({_PRED}) GROUP BY ALL),
s AS (SELECT gold AS label, sum(n) AS support, sum(n) FILTER (gold = predicted) AS tp FROM t GROUP BY 1),
p AS (SELECT predicted AS label, sum(n) AS n_predicted FROM t GROUP BY 1),
b AS (SELECT label, coalesce(support, 0)::BIGINT AS support, coalesce(n_predicted, 0)::BIGINT AS n_predicted, coalesce(tp, 0)::BIGINT AS tp FROM s FULL JOIN p USING (label)),
m AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / n_predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM b)
SELECT label, support, n_predicted, tp, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM m"""


def predictions(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return load(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").cast("string").alias("gold"), F.when(F.col("n_chars") < 600, "0").otherwise("1").alias("predicted"))


@register(_CLASS)
def confusion_prf1(spark, sf_dir):
    return M.class_scores(predictions(spark, sf_dir), "gold", "predicted")


@register(f"SELECT round(sum(tp) / sum(support), 4) AS micro_accuracy, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM ({_CLASS})")
def overall_prf1(spark, sf_dir):
    return M.overall_scores(confusion_prf1(spark, sf_dir))


@register(f"SELECT gold, predicted, count(*) AS n FROM ({_PRED}) WHERE gold <> predicted GROUP BY ALL ORDER BY n DESC, gold, predicted LIMIT 10")
def top_confusions(spark, sf_dir):
    return M.top_confusions(predictions(spark, sf_dir), "gold", "predicted")


@register("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
k AS (SELECT unnest([1, 2, 3]) AS k),
j AS (SELECT event_type, k, max(n) AS n, greatest(1, least(k * (max(n) + 1) // 4, max(n) - 1)) AS j FROM r, k GROUP BY event_type, k),
v AS (SELECT j.event_type, k, max(value) FILTER (i = j) AS lo, max(value) FILTER (i = j + 1) AS hi, max(k * (j.n + 1) - 4 * j) AS d FROM j JOIN r ON r.event_type = j.event_type GROUP BY j.event_type, k),
q AS (SELECT event_type, max(round((lo * (4 - d) + hi * d) / 4, 6)) FILTER (k = 1) AS q1, max(round((lo * (4 - d) + hi * d) / 4, 6)) FILTER (k = 2) AS q2, max(round((lo * (4 - d) + hi * d) / 4, 6)) FILTER (k = 3) AS q3 FROM v GROUP BY 1)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3 FROM events JOIN q USING (event_type) WHERE value IS NOT NULL GROUP BY 1""")
def quartiles_exclusive(spark, sf_dir):
    return M.exclusive_quartiles(load(spark, sf_dir, "events"), "event_type", "value")


@register("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running FROM conversations) WHERE running <= 600")
def budgeted_prefix(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    return R.budget_prefix(c, "conv_id", [F.col("turn")], F.col("len"), 600).select("conv_id", "turn", "running")


@register("""
WITH d AS (SELECT DISTINCT l_orderkey, p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, string_agg(p_brand, ', ' ORDER BY k, p_brand) AS cited, count(*) AS n FROM d GROUP BY 1""")
def citation_grouping(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    one = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct(X.canonical_number("p_brand").cast("int").alias("k"), "p_brand").alias("c"))
    grouped = one.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    return grouped.select("l_orderkey", F.array_join(F.transform("cs", lambda c: c["p_brand"]), ", ").alias("cited"), F.size("cs").cast("long").alias("n"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def source_extraction(spark, sf_dir):
    """First row per (document, article): here (customer, status)."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_custkey", "o_orderkey")
