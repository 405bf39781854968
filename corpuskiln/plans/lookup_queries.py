"""Registered queries of direct lookup, question and document parsing, layered classification and answer shaping.

The driver's tables stand in for a corpus: a part is a law, its order lines are
articles, a supplier asks.  Wordings are built from keys, so SQL knows what
parsing them has to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import legal as G
from corpuskiln.functions import rules as U
from corpuskiln.operators import answer as A
from corpuskiln.operators import layers as L
from corpuskiln.operators import lookup as K
from corpuskiln.operators import metrics as M
from corpuskiln.operators import ranks as R
from corpuskiln.operators import search as S
from corpuskiln.operators import store
from corpuskiln.plans.common import load
from corpuskiln.plans.text_queries import RULES, VOCABULARY

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


_CORPUS = """
docs AS (SELECT p_partkey AS document_id, p_partkey || '/' || (1990 + p_size % 30) || '/NĐ-CP' AS doc_number, 'Luật ' || p_name || ' ' || lower(p_type) AS title FROM part),
arts AS (SELECT l_partkey * 10 + l_linenumber AS article_id, l_partkey AS document_id, l_linenumber AS no, 'Điều ' || l_linenumber AS article_number,
  CASE l_linenumber % 3 WHEN 0 THEN 'Phạm vi áp dụng' WHEN 1 THEN 'Hành vi bị cấm' ELSE 'Mức phạt tiền' END AS title, 'dung lượng ' || count(*) AS content FROM lineitem GROUP BY l_partkey, l_linenumber),
clauses AS (SELECT article_id * 10 + k AS clause_id, article_id, 'Khoản ' || k AS clause_number, 'khoản ' || k AS said FROM arts, (VALUES (1), (2)) v(k)),
ask AS (SELECT s_suppkey AS query_id, s_suppkey % 7 + 1 AS n, p_partkey AS document_id, p_name AS name, 1990 + p_size % 30 AS y, p_partkey || '/' || (1990 + p_size % 30) || '/NĐ-CP' AS number FROM supplier JOIN part ON s_suppkey = p_partkey)"""


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, articles, clauses)."""
    part = load(spark, sf_dir, "part")
    number = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), (1990 + F.col("p_size") % 30).cast("string"), F.lit("/NĐ-CP"))
    day = F.lit(None).cast("date")
    docs = part.select(F.col("p_partkey").alias("document_id"), number.alias("doc_number"), F.concat(F.lit("Luật "), "p_name", F.lit(" "), F.lower("p_type")).alias("title"), day.alias("issued_date"), day.alias("effective_date"))
    n = F.col("l_linenumber")
    title = F.when(n % 3 == 0, "Phạm vi áp dụng").when(n % 3 == 1, "Hành vi bị cấm").otherwise("Mức phạt tiền")
    arts = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.concat(F.lit("dung lượng "), F.count("*").cast("string")).alias("content"))
    arts = arts.select((F.col("l_partkey") * 10 + n).alias("article_id"), F.col("l_partkey").alias("document_id"), F.concat(F.lit("Điều "), n.cast("string")).alias("article_number"), title.alias("title"), "content")
    k = F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    clauses = arts.select("article_id", k).select((F.col("article_id") * 10 + F.col("k")).alias("clause_id"), "article_id", F.concat(F.lit("Khoản "), F.col("k").cast("string")).alias("clause_number"), F.concat(F.lit("khoản "), F.col("k").cast("string")).alias("content"))
    return docs, arts, clauses


def asked(spark: SparkSession, sf_dir: str, *wordings: str) -> DataFrame:
    """(query_id, query): a supplier asks about the part of its key, in the wording of its key modulo their number;
    {n} is an article's number, {name} the part's name, {y} its year, {number} its number."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", (1990 + F.col("p_size") % 30).cast("string").alias("y"))
    rows = s.join(p, F.col("s_suppkey") == F.col("p_partkey"))
    parts = {"{n}": (F.col("s_suppkey") % 7 + 1).cast("string"), "{name}": F.col("p_name"), "{y}": F.col("y"), "{number}": F.concat_ws("/", F.col("p_partkey").cast("string"), "y", F.lit("NĐ-CP"))}
    text = None
    for i, wording in enumerate(wordings):
        said = F.lit(wording)
        for mark, value in parts.items():
            said = F.replace(said, F.lit(mark), value)
        hit = F.col("s_suppkey") % len(wordings) == i
        text = F.when(hit, said) if text is None else text.when(hit, said)
    return rows.select(F.col("s_suppkey").alias("query_id"), text.alias("query"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("query_id", "document_id", "article_id", "clause_id", "score", F.md5("text").alias("digest"))


_LINE = "d.title || chr(10) || a.article_number || '. ' || a.title || chr(10)"
_WHOLE = f"SELECT f.query_id, d.document_id, a.article_id, NULL::BIGINT AS clause_id, 1.0::DOUBLE AS score, md5({_LINE} || a.content) AS digest FROM found f JOIN arts a USING (article_id) JOIN docs d ON d.document_id = a.document_id"
_PARTS = f"SELECT f.query_id, d.document_id, a.article_id, c.clause_id, 0.95::DOUBLE AS score, md5({_LINE} || c.clause_number || chr(10) || c.said) AS digest FROM found f JOIN arts a USING (article_id) JOIN docs d ON d.document_id = a.document_id JOIN clauses c ON c.article_id = a.article_id"
_NAMED = """
named AS (SELECT query_id, n, d.document_id FROM ask JOIN docs d ON list_sum(list_transform(string_split(name, ' '), lambda w: (NOT contains(lower(d.title), w))::INT)) = 0 AND (query_id % 2 = 0 OR contains(d.doc_number, y::VARCHAR) OR contains(d.title, y::VARCHAR))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d.document_id DESC) <= 10)"""


@register(f"""
WITH {_CORPUS}, {_NAMED}, found AS (SELECT query_id, article_id FROM named JOIN arts USING (document_id) WHERE no = n),
every AS ({_WHOLE} UNION ALL {_PARTS})
SELECT query_id, document_id, article_id, clause_id, CASE WHEN query_id % 2 = 0 THEN 1.0 ELSE score END AS score, digest FROM every WHERE query_id % 2 = 1 OR clause_id % 10 = 2""")
def article_lookup(spark, sf_dir):
    """Even keys ask for a clause of an article, odd ones for the article in a law of a year."""
    q = asked(spark, sf_dir, "Khoản 2 Điều {n} Luật {name} quy định gì?", "Điều {n} Luật {name} năm {y} quy định về gì?")
    return digest(K.article_lookup(q, *corpus(spark, sf_dir)))


@register(f"""
WITH {_CORPUS}, hit AS (SELECT query_id, article_id FROM ask JOIN arts USING (document_id) WHERE query_id % 2 = 1 AND no % 3 = 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY article_id) <= 10),
found AS (FROM hit UNION ALL SELECT query_id, article_id FROM ask JOIN arts USING (document_id) WHERE query_id NOT IN (SELECT query_id FROM hit) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY article_id) <= 30)
{_WHOLE} UNION ALL {_PARTS}""")
def number_lookup(spark, sf_dir):
    q = asked(spark, sf_dir, "Tóm tắt {number}", "Mức phạt trong {number} thế nào")
    return digest(K.number_lookup(q, *corpus(spark, sf_dir)))


@register(f"""
WITH {_CORPUS}, {_NAMED.replace("query_id % 2 = 0 OR", "true OR")}, found AS (SELECT query_id, article_id FROM named JOIN arts USING (document_id) WHERE no % 3 = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY article_id) <= 10)
{_WHOLE} UNION ALL {_PARTS}""")
def topic_lookup(spark, sf_dir):
    return digest(K.topic_lookup(asked(spark, sf_dir, "Hành vi bị cấm trong Luật {name}"), *corpus(spark, sf_dir)))


@register(f"""
WITH {_CORPUS}, r AS (SELECT query_id, article_id, no, n, query_id % 4 AS kind, query_id % 4 = 0 AND split_part(content, ' ', 3) = n::VARCHAR AS said, row_number() OVER (PARTITION BY query_id ORDER BY article_id) AS i FROM ask JOIN arts USING (document_id)),
w AS (SELECT *, bool_or(kind = 0 AND no = n) OVER (PARTITION BY query_id) AS hit, bool_or(kind = 2 AND no % 3 = 1) OVER (PARTITION BY query_id) AS alike, bool_or(said) OVER (PARTITION BY query_id) AS shared FROM r),
v AS (SELECT *, CASE WHEN hit THEN 'asked' WHEN alike THEN 'title' WHEN kind = 1 THEN 'general' WHEN kind = 3 OR shared THEN 'overlap' ELSE 'first' END AS way FROM w),
o AS (SELECT query_id, article_id, way, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN way = 'title' AND no % 3 = 1 OR way = 'overlap' AND said THEN 0 ELSE 1 END, article_id) AS rank FROM v WHERE way <> 'asked' OR no = n)
SELECT query_id, article_id, way, (CASE WHEN way IN ('overlap', 'first') THEN 0.78 ELSE 1.0 END)::DOUBLE AS score, rank FROM o WHERE rank <= CASE way WHEN 'asked' THEN 1 WHEN 'title' THEN 1 WHEN 'general' THEN 30 WHEN 'overlap' THEN 18 ELSE 15 END""")
def direct_article_choice(spark, sf_dir):
    docs, arts, _ = corpus(spark, sf_dir)
    q = K.parsed(asked(spark, sf_dir, "Xem Điều {n}", "Tóm tắt", "hành vi bị cấm", "lượng dung")).select("query_id", "query", "article", "general")
    held = q.withColumn("document_id", F.col("query_id")).join(docs.select("document_id", F.col("title").alias("document_title")), "document_id")
    return K.choose_articles(held, arts)


_FLAT = "replace(lower(x.doc_number), 'đ', 'd')"


@register(f"""
WITH {_CORPUS}, t AS (
  SELECT query_id, x.document_id, 1 AS tier FROM ask JOIN docs x ON query_id % 2 = 0 AND contains({_FLAT}, replace(lower(number), 'đ', 'd'))
  UNION ALL SELECT query_id, x.document_id, 3 FROM ask JOIN docs x ON query_id % 2 = 1 AND list_sum(list_transform(string_split('luật ' || name, ' '), lambda w: (NOT contains(lower(x.title), w))::INT)) = 0)
SELECT query_id, min(document_id) AS document_id, min(tier)::BIGINT AS tier FROM t GROUP BY 1""")
def best_document(spark, sf_dir):
    docs, _, _ = corpus(spark, sf_dir)
    return K.best_document(asked(spark, sf_dir, "Nội dung {number}", "luật {name}"), docs)


@register(f"WITH {_CORPUS} SELECT docs.document_id, count(article_id) AS n_articles, coalesce(string_agg(article_number || '. ' || arts.title, '|' ORDER BY article_id), '') AS titles FROM docs LEFT JOIN arts USING (document_id) GROUP BY 1")
def article_titles(spark, sf_dir):
    docs, arts, _ = corpus(spark, sf_dir)
    return K.article_titles(docs, arts).select("document_id", "n_articles", F.array_join("titles", "|").alias("titles"))


@register(f"""
WITH {_CORPUS}, s AS (SELECT query_id, 1 AS side, number FROM ask UNION ALL SELECT query_id, 2, (document_id) || '/' || y || '/QĐ-XX' FROM ask)
SELECT query_id, side::BIGINT AS side, min(x.document_id) AS document_id FROM s LEFT JOIN docs x ON contains({_FLAT}, replace(lower(number), 'đ', 'd')) OR side = 2 AND split_part(x.doc_number, '/', 1) || split_part(x.doc_number, '/', 2) = split_part(number, '/', 1) || split_part(number, '/', 2) GROUP BY 1, 2""")
def compared_documents(spark, sf_dir):
    """The second name's number isn't held; its number and year are."""
    docs, _, _ = corpus(spark, sf_dir)
    q = asked(spark, sf_dir, "So sánh nghị định {number} với nghị định {number}").withColumn("query", F.regexp_replace("query", "NĐ-CP$", "QĐ-XX"))
    return K.compared_documents(q, docs)


@register(f"""
WITH {_CORPUS}, q(query_id, field, kws) AS (VALUES (1::BIGINT, 'ring', ['lượng 4', 'lượng 5']), (2, NULL, ['lượng 6']), (3, 'red', []::VARCHAR[]))
SELECT query_id, article_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY article_id) AS rank FROM arts JOIN docs USING (document_id), q
WHERE (field IS NULL OR contains(lower(docs.title), field)) AND (len(kws) = 0 OR list_bool_or(list_transform(kws, lambda k: contains(lower(content), k)))) QUALIFY rank <= 20""")
def metadata_search(spark, sf_dir):
    docs, arts, _ = corpus(spark, sf_dir)
    q = spark.sql("SELECT * FROM VALUES (1L, 'Ring', array('lượng 4', 'Lượng 5')), (2L, NULL, array('lượng 6')), (3L, 'red', CAST(array() AS ARRAY<STRING>)) AS q(query_id, field, keywords)")
    return K.metadata_search(q, docs, arts.select(F.col("article_id").alias("chunk_id"), "document_id", F.col("content").alias("text")))


_PASSAGES = f"""
{_CORPUS}, p AS (SELECT query_id, a.document_id, a.article_id, no, n, a.title, content, round(1.0 / (no + 1), 6) AS rerank_score, CASE WHEN no % 2 = 0 THEN 'token_sub' ELSE 'clause' END AS kind FROM ask JOIN arts a USING (document_id)),
m AS (SELECT *, round(rerank_score + 0.8 * CASE WHEN no % 3 = 2 THEN 2.0 / 3 ELSE 0 END + 0.5 * 0.25 + CASE WHEN no = n THEN 5 ELSE 0 END + CASE WHEN kind = 'token_sub' THEN 1.5 * 0.25 ELSE 0 END, 6) AS match FROM p)"""


def scored_passages(spark, sf_dir):
    _, arts, _ = corpus(spark, sf_dir)
    q = asked(spark, sf_dir, "mức phạt dung thử").withColumn("n", (F.col("query_id") % 7 + 1).cast("string"))
    rows = q.join(arts, F.col("query_id") == F.col("document_id")).withColumn("no", F.col("article_id") % 10)
    kind = F.when(F.col("no") % 2 == 0, "token_sub").otherwise("clause")
    rows = rows.withColumn("rerank_score", F.round(1.0 / (F.col("no") + 1), 6))
    match = K.match_score(F.col("query"), F.col("n"), F.lit(False), F.col("rerank_score"), F.col("title"), F.col("content"), F.col("no").cast("string"), kind)
    return rows.select("query_id", "document_id", "article_id", F.round(match, 6).alias("match"), "rerank_score")


@register(f"WITH {_PASSAGES} SELECT query_id, document_id, article_id, match, rerank_score FROM m")
def article_match_score(spark, sf_dir):
    return scored_passages(spark, sf_dir)


@register(f"""
WITH {_PASSAGES}, g AS (SELECT query_id, article_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY match DESC, document_id, article_id) AS group_rank FROM m QUALIFY group_rank <= 2)
SELECT query_id, article_id, rerank_score, group_rank, clause_id AS chunk_id, said AS text FROM g JOIN clauses USING (article_id)""")
def article_expansion(spark, sf_dir):
    _, _, clauses = corpus(spark, sf_dir)
    return K.expanded_articles(scored_passages(spark, sf_dir), clauses.select("article_id", F.col("clause_id").alias("chunk_id"), F.col("content").alias("text")), 2)


@register("""
WITH v AS (SELECT o_custkey AS query_id, o_orderkey % 3 AS variant, floor(o_totalprice)::BIGINT % 50 AS doc_id, o_orderkey AS rank, round(o_totalprice / 1000000, 6) AS score FROM orders),
o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, variant, rank) = 1)
SELECT query_id, doc_id, variant, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM o) WHERE n <= 6""")
def merged_variants(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).alias("variant"), (F.floor("o_totalprice").cast("long") % 50).alias("doc_id"), F.col("o_orderkey").alias("rank"), F.round(F.col("o_totalprice") / 1000000, 6).alias("score"))
    return K.merged_variants(rows, 3).select("query_id", "doc_id", "variant", "score", "rank")


@register("""
WITH a AS (SELECT c_nationkey AS query_id, c_custkey AS id, c_mktsegment AS text FROM customer WHERE c_acctbal < 3000), b AS (SELECT c_nationkey AS query_id, c_custkey AS id, c_mktsegment AS text FROM customer WHERE c_acctbal >= 3000)
FROM a UNION ALL SELECT * FROM b WHERE (query_id, text) NOT IN (SELECT query_id, text FROM a) QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY id) = 1""")
def missing_chunk_merge(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("rank"), F.col("c_mktsegment").alias("text"), "c_acctbal")
    return K.with_missing(c.filter("c_acctbal < 3000"), c.filter("c_acctbal >= 3000")).select("query_id", "id", "text")


@register(f"""
WITH {_CORPUS}, t AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'Luật sửa đổi, bổ sung ' || title ELSE title END AS title FROM docs),
p AS (SELECT query_id, a.document_id, article_id, no, round(1.0 / (no + a.document_id - ask.document_id), 6) AS s FROM ask JOIN arts a ON a.document_id IN (ask.document_id, ask.document_id + 1) AND no <= 2),
h AS (SELECT query_id, document_id, max(s) AS s FROM p JOIN t USING (document_id) WHERE contains(title, 'sửa đổi') GROUP BY 1, 2),
u AS (SELECT query_id, a.document_id, a.article_id AS chunk_id, h.s AS rerank_score, 1 AS src, 0 AS r FROM h JOIN arts a USING (document_id)
  UNION ALL SELECT query_id, document_id, article_id, s, 2, article_id FROM p WHERE (query_id, document_id) NOT IN (SELECT query_id, document_id FROM h))
SELECT query_id, document_id, chunk_id, rerank_score::DOUBLE AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY src, r, document_id, chunk_id) AS rank FROM u QUALIFY rank <= 6""")
def amended_articles(spark, sf_dir):
    """Passages of a part and the next one; every third part is an amending law, of which all articles come."""
    docs, arts, _ = corpus(spark, sf_dir)
    docs = docs.withColumn("title", F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("Luật sửa đổi, bổ sung "), "title")).otherwise(F.col("title")))
    q = asked(spark, sf_dir, "x").select("query_id", F.explode(F.array("query_id", F.col("query_id") + 1)).alias("document_id"))
    rows = q.join(arts, "document_id").withColumn("no", F.col("article_id") % 10).filter("no <= 2")
    score = F.round(1.0 / (F.col("no") + F.col("document_id") - F.col("query_id")), 6)
    rows = rows.select("query_id", "document_id", F.col("article_id").alias("chunk_id"), score.alias("rerank_score"), F.col("article_id").alias("rank"))
    chunks = arts.select("document_id", F.col("article_id").alias("chunk_id"))
    return K.amendments_expanded(rows, docs, chunks, 6).select("query_id", "document_id", "chunk_id", "rerank_score", "rank")


# Parsing


@register(f"""
WITH {_CORPUS} SELECT query_id, CASE WHEN query_id % 3 < 2 THEN n::VARCHAR END AS article, CASE WHEN query_id % 3 = 0 THEN '2' END AS clause, CASE WHEN query_id % 3 = 0 THEN 'b' END AS point,
CASE WHEN query_id % 3 < 2 THEN 'Luật ' || name END AS name, CASE WHEN query_id % 3 = 1 THEN y WHEN query_id % 3 = 2 AND document_id < 1000 THEN y END AS year,
CASE WHEN query_id % 3 = 2 THEN document_id || '/NĐ-CP' END AS number, query_id % 3 = 2 AS general, false AS several FROM ask""")
def question_parse(spark, sf_dir):
    q = asked(spark, sf_dir, "Điểm b khoản 2 điều {n} Luật {name}, theo đó là gì?", "Điều {n} Luật {name} năm {y} nói gì", "Tóm tắt {number} năm {y}")
    q = q.withColumn("query", F.regexp_replace("query", r"(\d+)/\d{4}/NĐ-CP", "$1NĐ – CP"))
    return K.parsed(q).drop("query")


_FLAGGED = {
    "mức phạt bao nhiêu": "asks_fine,needs_synthesis", "Thẩm quyền của ai": "asks_authority,needs_synthesis", "Điều 7 nói về": "names_article,needs_synthesis", "Chính sách của nhà nước": "is_comprehensive",
    "điều kiện thành lập là gì": "needs_synthesis,is_procedural,asks_conditions", "Liệt kê hành vi cấm": "asks_prohibited,is_general,wants_several", "Luật sửa đổi": "is_amendment", "xin chào": "",
}
_FLAG_ROWS = ", ".join(f"({i}, '{q}', '{want}')" for i, (q, want) in enumerate(_FLAGGED.items()))


@register(f"SELECT s_suppkey AS query_id, want AS flags FROM supplier JOIN (VALUES {_FLAG_ROWS}) v(i, q, want) ON s_suppkey % {len(_FLAGGED)} = i")
def question_flags(spark, sf_dir):
    q = asked(spark, sf_dir, *_FLAGGED)
    named = [F.when(c, F.lit(k)) for k, c in G.question_flags(F.col("query")).items()]
    return q.select("query_id", F.array_join(F.array_compact(F.array(*named)), ",").alias("flags"))


def written_documents(spark, sf_dir):
    """A decree in full form per supplier: (k, stem, text)."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    text = (
        "CHÍNH PHỦ | CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nSố: {k} / 2025 / NĐ-CP\nHà Nội, ngày 07 tháng 03 năm 2025\nNGHỊ ĐỊNH\nVề việc Quản lý lễ hội {k}\n"
        "Căn cứ Số: 5/2020/TT-BTC\nĐiều 1. Phạm vi\nCó hiệu lực thi hành kể từ ngày 31 tháng 2 năm 2025, sau đó hiệu lực từ ngày 1 tháng 7 năm 2025."
    )
    k = F.col("k").cast("string")
    stem = F.when(F.col("k") % 4 == 0, F.concat(k, F.lit("_2024_TT-ABC_99"))).when(F.col("k") % 4 == 1, F.concat(F.lit("Nghị định "), F.when(F.length(k) < 2, F.lpad(k, 2, "1")).otherwise(k), F.lit("2021NĐ-CP ngày"))).otherwise(F.concat(F.lit("ban "), k))
    return s.select("k", stem.alias("stem"), F.replace(F.lit(text), F.lit("{k}"), k).alias("text"))


@register("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier), n AS (SELECT *, CASE m WHEN 0 THEN k || '/2024/TT-ABC' WHEN 1 THEN CASE WHEN k < 10 THEN '1' || k ELSE k::VARCHAR END || '/2021/NĐ-CP' ELSE k || '/2025/NĐ-CP' END AS number FROM s)
SELECT k, number, CASE WHEN m = 0 THEN 'Thông tư' ELSE 'Nghị định' END AS kind, '2025-03-07' AS issued, NULL::VARCHAR AS effective, 'Về việc Quản lý lễ hội ' || k AS subject,
CASE WHEN m = 0 THEN 'Thông tư' ELSE 'Nghị định' END || ' ' || replace(number, '/', '') || ' ngày 07032025 quản lý lễ hội ' || k AS title, k || '/2025/NĐ-CP,5/2020/TT-BTC' AS numbers FROM n""")
def document_metadata(spark, sf_dir):
    """Number, kind, dates, subject and title of written decrees; the first date of effect doesn't exist."""
    d = written_documents(spark, sf_dir).withColumn("number", G.document_number(F.col("stem"), F.col("text")))
    d = d.withColumn("kind", G.document_kind(F.col("number"), F.col("stem"), F.col("text")))
    d = d.withColumn("subject", G.subject(F.col("text"), F.col("kind"))).withColumn("day", G.issued_date(F.col("text")))
    title = G.canonical_title(F.col("kind"), F.col("number"), F.col("day"), F.col("subject"))
    return d.select("k", "number", "kind", F.col("day").cast("string").alias("issued"), G.effective_date(F.col("text")).cast("string").alias("effective"), "subject", title.alias("title"), F.array_join(G.all_numbers(F.col("text")), ",").alias("numbers"))


@register("SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || '/2024/QH15' WHEN 1 THEN s_suppkey || '/2024/QH15' ELSE 'ban ' || s_suppkey END AS doc_number, s_suppkey % 3 = 0 AS repaired FROM supplier")
def repaired_numbers(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    number = F.when(F.col("s_suppkey") % 3 == 0, F.concat(k, F.lit("_2024_QH15_583769"))).when(F.col("s_suppkey") % 3 == 1, F.concat(k, F.lit("/2024/QH15"))).otherwise(F.concat(F.lit("ban "), k))
    return store.repaired_numbers(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), number.alias("doc_number")))


# Layers


_STRUCT = "CASE label WHEN 'lookup' THEN 0.98 WHEN 'explain' THEN 0.91 WHEN 'question' THEN 0.80 WHEN 'general' THEN 0.55 END"
_RULE = "CASE WHEN regexp_matches(text, 'licen[cs]e|[0-9]{4}', 'i') THEN 'lookup' WHEN regexp_matches(text, '\\bwhy\\b|\\bhow\\b', 'i') THEN 'explain' WHEN contains(text, '?') THEN 'question' WHEN regexp_matches(text, '\\bthe\\b|\\band\\b', 'i') THEN 'general' END"


@register(f"""
WITH r AS (SELECT conv_id, turn, text, {_RULE} AS label, turn % 3 = 0 AS sem, len(string_split_regex(trim(text), '[ \\t\\n]+')) AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN length(trim(text)) < 3 THEN 'hoi_dap_chung' WHEN sem THEN 'admin' ELSE coalesce(label, 'hoi_dap_chung') END AS label,
CASE WHEN length(trim(text)) < 3 THEN 0.1 WHEN sem THEN 0.66 WHEN label IS NOT NULL THEN round({_STRUCT}, 2) WHEN w <= 2 THEN 0.4 WHEN w <= 4 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence,
CASE WHEN length(trim(text)) < 3 THEN 'guard' WHEN sem THEN 'semantic' WHEN label IS NOT NULL THEN 'structural' ELSE 'llm' END AS method FROM r""")
def layered_intent(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    semantic = F.when(F.col("turn") % 3 == 0, L.verdict("admin", 0.66))
    structural = U.first_match(F.col("text"), RULES, "(?i)")
    return rows.select("conv_id", "turn", L.layered(F.col("text"), semantic=semantic, structural=structural).alias("v")).select("conv_id", "turn", "v.*")


@register(f"""
WITH r AS (SELECT conv_id, turn, text, {_RULE} AS label FROM conversations)
SELECT conv_id, turn, coalesce(label, CASE WHEN turn % 2 = 0 THEN 'admin' ELSE 'hoi_dap_chung' END) AS label, coalesce({_STRUCT}, CASE WHEN turn % 2 = 0 THEN 0.66 ELSE 0.3 END)::DOUBLE AS confidence FROM r WHERE trim(text) <> ''""")
def layered_by_rules(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").filter("trim(text) != ''")
    found = L.layered_by_rules(F.col("text"), structural=U.first_match(F.col("text"), RULES, "(?i)"), semantic=F.when(F.col("turn") % 2 == 0, L.verdict("admin", 0.66)))
    return rows.select("conv_id", "turn", found.alias("v")).select("conv_id", "turn", "v.*")


def _count_sql(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


_DOMAINS = ", ".join(f"{{'n': {_count_sql(w)}, 'i': {i}, 'd': '{k}'}}" for i, (k, w) in enumerate(VOCABULARY.items()))


@register(f"""
WITH u AS (SELECT doc_id, unnest([{_DOMAINS}]) AS x FROM documents),
h AS (SELECT doc_id, x.d AS d, round(least(0.5 + 0.15 * x.n, 0.9), 3) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY -round(least(0.5 + 0.15 * x.n, 0.9), 3), x.i) AS rn FROM u WHERE x.n > 0),
g AS (SELECT doc_id, string_agg(d, ',' ORDER BY rn) FILTER (rn <= 2) AS f, string_agg(d, ',' ORDER BY rn) FILTER (rn <= 3) AS l FROM h GROUP BY 1)
SELECT doc_id, f AS filter, coalesce(l, 'chung') AS labels FROM documents LEFT JOIN g USING (doc_id)""")
def domain_filter_values(spark, sf_dir):
    hits = load(spark, sf_dir, "documents").select("doc_id", L.domain_hits(F.col("text"), VOCABULARY, n=3).alias("hits"))
    return hits.select("doc_id", F.array_join(L.domain_filter(F.col("hits")), ",").alias("filter"), F.array_join(L.document_labels(F.col("hits")), ",").alias("labels"))


@register("SELECT event_id, CASE WHEN round(value / 100 - k / 100.0, 9) >= 0.1 THEN true WHEN round(k / 100.0 - value / 100, 9) >= 0.1 THEN false ELSE event_id % 2 = 0 END AS communal FROM (SELECT event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def margin_route(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("a"), (F.get_json_object("props", "$.k").cast("long") / 100).alias("b"))
    return e.select("event_id", L.margin_route(F.col("a"), F.col("b"), F.col("event_id") % 2 == 0).alias("communal"))


# Answers


@register("""
WITH a AS (SELECT c_nationkey AS query_id, c_custkey AS rank, 'QĐ ' || c_mktsegment AS label, c_custkey % 12 + 1 AS art FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, bool_or(art IN (3, 11)) OVER (PARTITION BY query_id) AS hit FROM a),
f AS (SELECT * FROM k WHERE CASE WHEN query_id % 2 = 0 THEN n <= 12 WHEN hit THEN art IN (3, 11) ELSE n <= 10 END),
d AS (SELECT query_id, label, min(rank) AS r, string_agg(DISTINCT art, ', ' ORDER BY art) AS arts FROM f GROUP BY 1, 2)
SELECT query_id, 'Căn cứ pháp lý:' || chr(10) || string_agg('- ' || label || ': Điều ' || arts, chr(10) ORDER BY r) AS basis FROM d GROUP BY 1""")
def legal_basis(spark, sf_dir):
    """Even nations' answers name no article, odd ones' name 3 and 11."""
    c = load(spark, sf_dir, "customer")
    found = c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("rank"), F.concat(F.lit("QĐ "), "c_mktsegment").alias("doc_number"), F.lit("").alias("document_title"), F.concat(F.lit("Điều "), (F.col("c_custkey") % 12 + 1).cast("string")).alias("article_number"))
    answers = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_nationkey") % 2 == 0, "không rõ").otherwise("Theo Điều 3 và điều 11").alias("answer"))
    return A.legal_basis(found, answers)


@register("""
WITH a AS (SELECT doc_id, trim(text) AS t FROM documents WHERE trim(text) <> '')
SELECT doc_id, md5('Câu trả lời:' || chr(10) || chr(10) || t || chr(10) || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'c' WHEN doc_id % 10 < 5 THEN 'b' ELSE 'a' END) AS digest FROM a""")
def shaped_answer(spark, sf_dir):
    texts = {"no_info": "d", "no_sources": "c", "unsure": "b", "else": "a"}
    d = load(spark, sf_dir, "documents").withColumn("t", F.trim("text")).filter("t != ''")
    shaped = A.follow_up(A.with_heading(F.col("t")), (F.col("doc_id") % 10) / 10, F.col("doc_id") % 3 != 0, texts)
    return d.select("doc_id", F.md5(shaped).alias("digest"))


@register("""
SELECT c_nationkey AS query_id, o_custkey, o_orderkey, in_group FROM (
  SELECT c_nationkey, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS in_group, n FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT c_nationkey, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (c_nationkey))
WHERE in_group <= greatest(1, 40 // n) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY in_group, o_custkey, o_orderkey) <= 40""")
def quota_with_overall_cap(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("query_id"))
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    return R.quota(rows, "o_custkey", [F.col("o_orderkey")], 40, over="query_id").select("query_id", "o_custkey", "o_orderkey", "in_group")


@register("""
WITH a AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer WHERE c_acctbal < c_nationkey * 300),
b AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
u AS (SELECT *, 0 AS list FROM a WHERE rank <= 12 UNION ALL SELECT *, 1 FROM b WHERE rank <= 12),
o AS (SELECT query_id, doc_id, min(list) AS list, arg_min(rank, list * 1000 + rank) AS rank_in_list FROM u GROUP BY 1, 2),
n AS (SELECT *, count(*) FILTER (list = 0) OVER (PARTITION BY query_id) AS own FROM o)
SELECT query_id, doc_id, list, rank_in_list, row_number() OVER (PARTITION BY query_id ORDER BY list, rank_in_list, doc_id) AS rank FROM n WHERE list = 0 OR own < 10 QUALIFY rank <= 10""")
def topped_up_search(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("doc_id"), "c_acctbal")
    a = R.top_k(c.filter(F.col("c_acctbal") < F.col("query_id") * 300), "query_id", [F.col("doc_id")], 12)
    b = R.top_k(c, "query_id", [F.col("c_acctbal").desc(), F.col("doc_id")], 12)
    return S.topped_up([a, b], 10)


@register("""
WITH p AS (SELECT s_suppkey AS query_id, p_partkey AS part, p_name || ' ' || lower(p_type) AS held FROM supplier JOIN part ON p_partkey % 40 = s_suppkey % 40)
SELECT query_id, arg_min(part, row_number) AS part, arg_min(held, row_number) AS held FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT contains(lower(held), 'red'), abs(length(held) - 3), held, part) AS row_number FROM p) GROUP BY 1""")
def closest_text(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 40).alias("m"), F.lit("red").alias("asked"))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("held"), (F.col("p_partkey") % 40).alias("m"))
    return S.closest_among(s, p, "m", "asked", "held", "part")


@register("SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '[?]')) AS asks, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits, round(avg(length(text)), 4) AS chars FROM conversations")
def flag_tallies(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(F.rlike("text", F.lit("[?]")).alias("asks"), F.rlike("text", F.lit("[0-9]")).alias("digits"), F.length("text").alias("chars"))
    return M.tallies(rows, ["asks", "digits"], ["chars"])


_WORDINGS = ("Khoản 3 nói gì", "100/2019/NĐ-CP", "điều 12 nghĩa là gì", "So sánh hai bên", "mức phạt", "thủ tục cấp phép", "danh mục", "khác nhau ra sao", "")
_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SAYS = lambda words: f"len(list_filter({_LISTED(words)}, lambda w: contains(lower(q), w))) > 0"


@register(f"""
WITH t AS (SELECT conv_id, turn, {_LISTED(_WORDINGS)} AS ws, substr(text, 1, (turn * 20)::INT) AS tail FROM conversations),
s AS (SELECT conv_id, turn, trim(ws[conv_id % 9 + 1] || ' ' || ws[(conv_id + turn) % 9 + 1] || ' ' || tail, ' ' || chr(9) || chr(10) || chr(13)) AS q FROM t)
SELECT conv_id, turn, regexp_matches(lower(q), '(^|\\W)điều\\s+\\d+[a-z]?(\\W|$)') AS has_article_ref, regexp_matches(lower(q), 'khoản\\s+\\d+') AS has_clause_ref, regexp_matches(q, '\\d{{2,}}/\\d{{4}}/[A-ZĐa-zđ0-9\\-]+') AS has_doc_number,
  {_SAYS(G.PROCEDURAL)} AS is_procedure_like, {_SAYS(G.EXPLAINING)} AS needs_explanation, {_SAYS(G.COMPARING)} AS needs_comparison, {_SAYS(G.FINE)} AS asks_fine_amount, {_SAYS(G.BROAD)} AS needs_broad_coverage,
  length(q)::INT AS query_length, length(q) < 30 AS is_short_query, length(q) > 100 AS is_long_query FROM s""")
def question_features(spark, sf_dir):
    """Eleven features of texts that open with two wordings by their key."""
    c = load(spark, sf_dir, "conversations")
    said = lambda i: F.element_at(F.array(*map(F.lit, _WORDINGS)), (i % 9 + 1).cast("int"))
    q = F.concat_ws(" ", said(F.col("conv_id")), said(F.col("conv_id") + F.col("turn")), F.substring("text", F.lit(1), (F.col("turn") * 20).cast("int")))
    return c.select("conv_id", "turn", G.query_features(q).alias("f")).select("conv_id", "turn", "f.*")


@register("SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 25 AS page, count(*) OVER () AS total FROM documents")
def document_pages(spark, sf_dir):
    """Every document with its page in an order of all, as the pages lie on disk."""
    from corpuskiln.operators.paging import Pages

    pages = Pages.build(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 25, [F.col("n_chars").desc()])
    return pages.rows.select("doc_id", F.col("_page").alias("page"), F.lit(pages.total).cast("long").alias("total"))
