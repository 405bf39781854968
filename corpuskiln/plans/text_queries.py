"""Registered queries of text operators, rules, labels, features, answers and mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskiln.functions import rules as U
from corpuskiln.functions import text as X
from corpuskiln.operators import answer as A
from corpuskiln.operators import chunks as C
from corpuskiln.operators import metrics as M
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


_WS = r"string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')"


@register(f"""
WITH d AS (SELECT doc_id, list_filter({_WS}, lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, len(ws) AS n, CASE WHEN len(ws) <= 512 THEN 1 ELSE 1 + CAST(ceil((len(ws) - 512) / 432.0) AS BIGINT) END AS k FROM d WHERE len(ws) > 0),
w AS (SELECT doc_id, ws, unnest(generate_series(0, k - 1)) AS i FROM s)
SELECT doc_id, i::BIGINT AS chunk, (i * 432)::BIGINT AS start, len(list_slice(ws, i * 432 + 1, i * 432 + 512))::BIGINT AS n_words, md5(array_to_string(list_slice(ws, i * 432 + 1, i * 432 + 512), ' ')) AS digest FROM w""")
def token_window_chunks(spark, sf_dir):
    out = C.token_windows(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk", "start", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


_DROP = r"^\s*$|^Licensed under|^Released under"


@register(r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(l, '^\s*$|^Licensed under|^Released under')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM d""")
def line_filter_clean(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_lines("text", _DROP)).alias("digest"))


@register(r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT *, regexp_matches(line, '^[A-Z]\w+ [a-z]+ [^.]*\.$') AS head FROM l),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS article FROM h)
SELECT doc_id, article::BIGINT AS article, min(line_no)::BIGINT AS first_line, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM g GROUP BY doc_id, article""")
def article_islands(spark, sf_dir):
    parts = C.islands(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", r"^[A-Z]\w+ [a-z]+ [^.]*\.$")
    return parts.groupBy("doc_id", "article").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


FEATURES = {
    "asks": r"\?", "digits": r"[0-9]", "compares": r"compare|versus|differ", "lists": r"list|all of", "why": r"\bwhy\b|\bhow\b",
    "license": r"licen[cs]e", "contact": r"@|phone|call", "code": r"[{}<>]", "short": r"^.{0,80}$", "greets": r"\bhello\b|\bhi\b|\bthe\b",
}
_FSQL = ", ".join(f"regexp_matches(text, '{p}', 'is') AS {k}" for k, p in FEATURES.items())


def features(text="text"):
    return {k: F.rlike(text, F.lit(f"(?is){p}")) for k, p in FEATURES.items()}


@register(f"SELECT conv_id, turn, {_FSQL}, length(text)::BIGINT AS query_length FROM conversations")
def regex_feature_matrix(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in features().items()], F.length("text").cast("long").alias("query_length"))


@register(f"""
WITH f AS (SELECT conv_id, turn, {_FSQL} FROM conversations),
s AS (SELECT conv_id, turn, round(0.5 * digits::INT + 0.4 * license::INT, 6) AS lookup, round(0.3 + 0.3 * why::INT, 6) AS semantic, round(0.35 * compares::INT + 0.4 * lists::INT + 0.1 * (NOT short)::INT, 6) AS multi FROM f),
u AS (SELECT conv_id, turn, unnest([{{'s': lookup, 'i': 0, 'n': 'lookup'}}, {{'s': semantic, 'i': 1, 'n': 'semantic'}}, {{'s': multi, 'i': 2, 'n': 'multi_query'}}]) AS x FROM s),
r AS (SELECT conv_id, turn, x.n AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY x.s DESC, x.i) AS rn FROM u WHERE x.s > 0)
SELECT conv_id, turn, string_agg(n, ',' ORDER BY rn) AS strategies FROM r WHERE rn <= 2 GROUP BY 1, 2""")
def strategy_scores(spark, sf_dir):
    f = {k: c.cast("int") for k, c in features().items()}
    scores = {"lookup": 0.5 * f["digits"] + 0.4 * f["license"], "semantic": 0.3 + 0.3 * f["why"], "multi_query": 0.35 * f["compares"] + 0.4 * f["lists"] + 0.1 * (1 - f["short"])}
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(U.strategies(scores), ",").alias("strategies"))


RULES = [
    U.Rule("lookup", (r"licen[cs]e", r"[0-9]{4}"), 20, 0.98),
    U.Rule("explain", (r"\bwhy\b", r"\bhow\b"), 10, 0.91),
    U.Rule("question", (r"\?",), 10, 0.80),
    U.Rule("general", (r"\bthe\b", r"\band\b"), 0, 0.55),
]
_RULE = "CASE WHEN regexp_matches(text, 'licen[cs]e|[0-9]{4}', 'i') THEN 'lookup' WHEN regexp_matches(text, '\\bwhy\\b|\\bhow\\b', 'i') THEN 'explain' WHEN contains(text, '?') THEN 'question' WHEN regexp_matches(text, '\\bthe\\b|\\band\\b', 'i') THEN 'general' END"


@register(f"SELECT conv_id, turn, label, CASE label WHEN 'lookup' THEN 0.98 WHEN 'explain' THEN 0.91 WHEN 'question' THEN 0.80 WHEN 'general' THEN 0.55 END::DOUBLE AS confidence FROM (SELECT conv_id, turn, {_RULE} AS label FROM conversations)")
def rule_first_match(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("m", U.first_match(F.col("text"), RULES, "(?i)"))
    return rows.select("conv_id", "turn", "m.label", "m.confidence")


@register(f"""
WITH b AS (SELECT conv_id, turn, text, {_RULE} AS label FROM conversations),
f AS (SELECT *, coalesce(label, '') = 'lookup' AS l0, coalesce(label, '') IN ('explain', 'general') AS m0, coalesce(label, '') = 'explain' AS e0, coalesce(label, '') IN ('lookup', 'explain', 'general') AS known FROM b),
g AS (SELECT *, CASE WHEN known THEN l0 ELSE regexp_matches(text, '[0-9]', 'i') END AS l1, CASE WHEN known THEN m0 ELSE regexp_matches(text, 'all', 'i') OR regexp_matches(text, 'penalty', 'i') END AS m1, regexp_matches(text, 'must|shall', 'i') AS force FROM f),
o AS (SELECT *, contains(lower(text), 'summary') AS o1 FROM g)
SELECT conv_id, turn, CASE WHEN o1 THEN false ELSE l1 END AS is_legal_lookup, CASE WHEN o1 THEN true ELSE m1 OR force END AS use_multi_article, CASE WHEN o1 THEN true ELSE e0 OR force END AS needs_expansion FROM o""")
def flag_pipeline(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("label", U.first_match(F.col("text"), RULES, "(?i)")["label"])
    base = {"lookup": (True, False, False), "explain": (False, True, True), "general": (False, True, False)}
    override = [U.Override("summary", ("summary",), {"use_multi_article": True, "needs_expansion": True})]
    flags = U.flag_pipeline(F.col("text"), F.coalesce("label", F.lit("")), base, ("[0-9]",), ("all",), ("penalty",), ("must|shall",), override)
    return rows.select("conv_id", "turn", flags.alias("f")).select("conv_id", "turn", "f.*")


VOCABULARY = {"licensing": ["license", "copyright", "version"], "abuse": ["idiot", "trash", "worthless", "scum"], "french": ["les ", "des ", "pour "], "german": ["und ", "der ", "das "]}


def _kw_sql(words):
    return f"(SELECT CASE WHEN n > 0 THEN round(least(0.5 + 0.15 * n, 0.9), 6)::DOUBLE END FROM (SELECT len(list_filter({words}, lambda w: contains(lower(text), w))) AS n))"


_LABELS = ", ".join("{'by': -round(" + _kw_sql(w) + f", 3), 'label': '{k}'}}" for k, w in VOCABULARY.items())


@register("SELECT doc_id, " + ", ".join(f"{_kw_sql(w)} AS {k}" for k, w in VOCABULARY.items()) + " FROM documents")
def keyword_label_confidence(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", *[U.keyword_confidence(F.col("text"), w).alias(k) for k, w in VOCABULARY.items()])


@register(f"""
WITH l AS (SELECT doc_id, unnest([{_LABELS}]) AS x FROM documents),
r AS (SELECT doc_id, x.label AS label, row_number() OVER (PARTITION BY doc_id ORDER BY x.by, x.label) AS rn FROM l WHERE x.by IS NOT NULL)
SELECT doc_id, coalesce(s, 'general') AS labels FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY rn) AS s FROM r WHERE rn <= 2 GROUP BY 1) USING (doc_id)""")
def multi_label_topn(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(U.labelled(F.col("text"), VOCABULARY), ",").alias("labels"))


@register("SELECT doc_id, round(least(round(n_chars::DOUBLE / (n_chars + 1000), 6) + 0.05 * (contains(text, 'License')::INT + contains(text, '.')::INT + contains(text, '|')::INT), 1.0), 3) AS confidence FROM documents")
def answer_confidence(spark, sf_dir):
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1000), 6)
    return load(spark, sf_dir, "documents").select("doc_id", A.confidence(score, F.col("text"), ["License", ".", "|"]).alias("confidence"))


@register(r"""
WITH p AS (SELECT a.conv_id, a.turn, len(list_distinct(regexp_extract_all(a.text, '[A-Z][a-z]+'))) AS answered, len(list_distinct(regexp_extract_all(q.text, '[A-Z][a-z]+'))) AS asked
FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant' AND q.role = 'user')
SELECT conv_id, turn, answered::BIGINT AS answered, asked::BIGINT AS asked, asked = 0 OR answered >= asked AS complete FROM p""")
def completeness_check(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    n = lambda t: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("[A-Z][a-z]+"), F.lit(0)))).cast("long")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    q = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    rows = a.join(q, ["conv_id", "turn"]).withColumn("complete", A.complete(F.col("context"), F.col("answer"), "([A-Z][a-z]+)"))
    return rows.select("conv_id", "turn", n("answer").alias("answered"), n("context").alias("asked"), "complete")


@register(r"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS t, string_split(a.text, chr(10)) AS ls, list_transform(regexp_extract_all(q.text, '[A-Z][a-z]+'), lambda w: lower(w)) AS known FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1),
k AS (SELECT *, list_filter(ls, lambda l: len(list_filter(regexp_extract_all(l, '[A-Z][a-z]+'), lambda w: NOT list_contains(known, lower(w)))) = 0) AS good FROM p)
SELECT conv_id, turn, CASE WHEN len(known) = 0 OR len(good) = len(ls) THEN t ELSE nullif(trim(regexp_replace(array_to_string(good, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), '') END AS kept FROM k""")
def strip_unsupported_lines(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    q = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return c.select("conv_id", "turn", "text").join(q, ["conv_id", "turn"]).select("conv_id", "turn", X.supported_lines("text", "context", "[A-Z][a-z]+").alias("kept"))


@register("SELECT doc_id, md5(replace(strip_accents(lower(text)), 'đ', 'd')) AS digest FROM documents")
def strip_accents_key(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold("text")).alias("digest"))


@register("""
WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
g AS (SELECT unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS phrase FROM t)
SELECT phrase, count(*) AS n FROM g GROUP BY 1""")
def ngram_counts(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    labelled = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    spoken = labelled.select(words.alias("ws"))  # a column first: inside a lambda the words would be found again for each of them
    return spoken.select(F.explode(M.ngrams(F.col("ws"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


@register("""
WITH s AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS ws, toxic AS y FROM documents JOIN labels USING (doc_id)),
b AS (SELECT avg(y) AS base FROM s),
g AS (SELECT DISTINCT rn, y, phrase FROM (SELECT row_number() OVER () AS rn, y, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS phrase FROM s) WHERE length(phrase) >= 4),
c AS (SELECT phrase, count(*) AS n, sum(y)::BIGINT AS hits FROM g GROUP BY 1),
m AS (SELECT * FROM c WHERE hits > 0 ORDER BY hits DESC, phrase LIMIT 400)
SELECT phrase, hits AS support, n, round(hits / n, 6) AS precision, round(hits / n / base, 6) AS lift FROM m, b WHERE hits >= 5 AND round(hits / n, 6) >= 0.7 ORDER BY lift DESC, precision DESC, support DESC, phrase LIMIT 12""")
def rule_mining_lift(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = load(spark, sf_dir, "documents").select("doc_id", words.alias("ws")).join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return M.mined_phrases(rows, "ws", F.col("toxic"))


@register("""
WITH q AS (SELECT conv_id || '-' || turn AS query_id, text AS query, lower(trim(text)) AS low FROM conversations WHERE role = 'user'),
v AS (SELECT query_id, list_slice(list_filter([query, 'what is ' || low, 'details about ' || low], lambda x: length(x) > 8), 1, 3) AS vs FROM q)
SELECT query_id, generate_subscripts(vs, 1) - 1 AS variant, unnest(vs) AS query FROM v""")
def expand_variants(spark, sf_dir):
    """Query variants of the offline provider: at most three, the original first."""
    from corpuskiln.operators.providers import variants

    return variants(load(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query")))


@register(r"""
WITH q AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(text, '\bpls\b', 'please', 'gi'), '\basap\b', 'as soon as possible', 'gi') AS r FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN length(text) BETWEEN 8 AND 400 AND length(r) <= greatest(4 * length(text), 300) AND NOT contains(r, chr(10) || chr(10)) THEN r ELSE text END AS query FROM q""")
def provider_rewrite(spark, sf_dir):
    from corpuskiln.operators.providers import rewrite

    rows = load(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", rewrite(F.col("text"), {"pls": "please", "asap": "as soon as possible"}).alias("query"))


PLAIN = dict(article=r"^([A-Z])\w+ [a-z]+ ([^.]*)\.$", clause=r"^\s*(\d{1,3})[.)]\s+(.*)$", chapter=r"^CHAPTER (\d+)(.*)$", section=r"^SECTION (\d+)(.*)$", appendix=r"^APPENDIX")


@register()
def structure_chunks(spark, sf_dir):
    """The ingest parser on plain documents: every chunk of every article."""
    from corpuskiln.operators.structure import Patterns, parsed

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return parsed(docs, Patterns(**PLAIN))["chunks"].select("document_id", "article_ord", "clause_number", "chunk_type", F.length("text").alias("n_chars"))


@register()
def parse_tree_udtf(spark, sf_dir):
    """The line-by-line parser: every article with its clauses and points, and how its pieces are stored."""
    from corpuskiln.operators import tree
    from corpuskiln.operators.structure import Patterns

    p = Patterns(**PLAIN)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    found = tree.articles(docs, p)
    n_points = F.aggregate("clauses", F.lit(0), lambda s, c: s + F.size(c["points"]))
    return found.select("document_id", "article_ord", "label", "title", F.md5("content").alias("digest"), F.size("clauses").alias("n_clauses"), n_points.alias("n_points"))
