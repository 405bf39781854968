"""Context assembly, sources, citations, confidence and answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions import legal as G
from corpuskiln.functions import text as X
from corpuskiln.operators import providers as P
from corpuskiln.operators import ranks as R
from corpuskiln.operators.search import small


def dedup_key() -> Column:
    """id, else (article, clause), else (article, vector), else the first 500 characters of 24 or more, else the row."""
    return F.coalesce(
        F.concat(F.lit("id:"), F.col("id")),
        F.concat(F.lit("ac:"), F.col("article_id").cast("string"), F.lit(":"), F.col("clause_id").cast("string")),
        F.concat(F.lit("av:"), F.col("article_id").cast("string"), F.lit(":"), F.col("vector_id")),
        F.when(F.length("text") >= 24, F.concat(F.lit("t:"), F.sha2(F.substring("text", 1, 500), 256))),
        F.concat(F.lit("row:"), F.col("rank").cast("string")),
    )


def deduped(passages: DataFrame) -> DataFrame:
    return R.first_by_key(passages.withColumn("_k", dedup_key()), ["query_id", "_k"], [F.col("rank")]).drop("_k")


def effective_score() -> Column:
    return F.coalesce("rerank_score", "rrf_score", "score", F.lit(0.0))


def grouped_context(passages: DataFrame, text: str = "text") -> DataFrame:
    """One block per article in order of first appearance: header, then its texts without repeats of
    the first 120 characters; blocks separated by lines of dashes."""
    article = X.canonical_number("article_number")
    rows = passages.withColumn("_a", article).withColumn("_cut", F.substring(text, 1, 120))
    rows = R.first_by_key(rows, ["query_id", "document_id", "_a", "_cut"], [F.col("rank")])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("t")))), lambda x: x["t"])
    head = F.min_by(F.concat_ws(" - ", "document_title", "article_number"), "rank")
    blocks = rows.groupBy("query_id", "document_id", "_a").agg(F.min("rank").alias("first"), head.alias("head"), parts.alias("parts"))
    blocks = blocks.withColumn("block", F.concat(F.lit("["), "head", F.lit("]\n"), F.array_join("parts", "\n")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first", "block"))), lambda x: x["block"])
    return blocks.groupBy("query_id").agg(F.array_join(ordered, "\n---\n").alias("context"), F.count("*").alias("n_articles"))


def sources(passages: DataFrame, text: str = "text") -> DataFrame:
    """The first row per (document number, article), with a snippet."""
    one = R.first_by_key(passages, ["query_id", "doc_number", "article_number"], [F.col("rank")])
    return one.withColumn("snippet", F.substring(text, 1, 500))


def citations(found: DataFrame) -> DataFrame:
    """'document: articles', documents in order of appearance, articles in natural order."""
    number = X.canonical_number("article_number")
    key = F.struct(F.regexp_extract(number, r"^(\d+)", 1).try_cast("int").alias("n"), F.regexp_extract(number, r"^\d+(.*)$", 1).alias("s"), F.col("article_number").alias("a"))
    per_doc = found.groupBy("query_id", "doc_number").agg(F.min("rank").alias("first"), F.sort_array(F.collect_set(key)).alias("as"))
    line = F.concat(F.col("doc_number"), F.lit(": "), F.array_join(F.transform("as", lambda x: x["a"]), ", "))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("first", line.alias("line")))), lambda x: x["line"])
    return per_doc.groupBy("query_id").agg(F.array_join(lines, "\n").alias("citations"))


def confidence(scores: Column, answer: Column, markers: list[str]) -> Column:
    """Mean score (an aggregate column) plus 0.05 per marker in the answer, at most 1, to 3 places."""
    extra = sum((F.contains(answer, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return F.round(F.least(scores + 0.05 * extra, F.lit(1.0)), 3)


def complete(context: Column, answer: Column, clause: str = r"(?m)^\s*(\d+)\.") -> Column:
    """An answer is complete when it numbers at least as many clauses as the context does."""
    n = lambda t: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(clause), F.lit(1))))
    return (n(context) == 0) | (n(answer) >= n(context))


def sanitised(answer: Column) -> Column:
    """Metadata objects and fields, code fences and glued numbers of a model's reply put right."""
    field = "sources|confidence_score|document_id|vector_score|similarity|embedding"
    out = F.regexp_replace(answer, rf'(?s)\{{[^{{}}]*"(?:{field})[^{{}}]*\}}', "")
    out = F.regexp_replace(out, rf'(?s)"(?:{field}|score|embedding_metadata)"\s*:\s*(?:\[.*?\]|"[^"]*"|\d+(?:\.\d+)?|null|true|false)', "")
    out = F.regexp_replace(F.regexp_replace(out, r"\{\s*,?\s*\}", ""), r"\[\s*,?\s*\]", "")
    out = F.replace(F.regexp_replace(out, r"```(?:\w+)?\n", ""), F.lit("```"), F.lit(""))
    return X.strip(G.unglued_numbers(F.regexp_replace(out, r"\n{3,}", "\n\n")))


# Shaping of answers

#: The heading of an answer and of its legal basis, and the text of an answer without information.
HEADING, BASIS = "Câu trả lời:", "Căn cứ pháp lý:"
NO_INFO = "Không tìm thấy nội dung phù hợp trong các tài liệu hiện có."


def is_no_info(answer: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return (low == NO_INFO.lower()) | F.contains(low, F.lit("không tìm thấy nội dung phù hợp"))


def with_heading(answer: Column) -> Column:
    """The answer under one heading; answers without information stay."""
    one = F.regexp_replace(X.strip(answer), rf"(?isU)^(?:\s*{HEADING[:-1]}\s*:\s*\n*){{2,}}", f"{HEADING}\n\n")
    headed = F.when(F.lower(one).startswith(HEADING[:-1].lower()), one).otherwise(F.concat(F.lit(f"{HEADING}\n\n"), one))
    return F.when(answer.isNull() | (F.trim(answer) == "") | (F.trim(answer) == NO_INFO), answer).otherwise(headed)


def _cut(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\s+$", "")


def without_basis(answer: Column) -> Column:
    """struct(text, cut): the answer up to a legal basis at its end; one in the first third of a longer text stays."""
    low, key = F.lower(answer), BASIS[:-1].lower()
    tail = F.length(F.substring_index(low, key, -1)) + len(key)
    at = F.length(answer) - tail  # where the last one begins
    held = F.contains(low, F.lit(key)) & ~((F.length(answer) > 100) & (at < F.floor(F.length(answer) * 0.35)))
    return F.struct(F.when(held, _cut(F.substring(answer, F.lit(1), at.cast("int")))).otherwise(answer).alias("text"), held.alias("cut"))


def source_label(number: Column, title: Column) -> Column:
    """'number (title)'; the title alone when it has the number, the number alone when the title is run together."""
    n, t = F.trim(F.coalesce(number, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    both = F.when((F.length(t) > 90) & (spaces < 5), n).when(F.contains(F.lower(t), F.lower(n)), t).otherwise(F.concat(n, F.lit(" ("), t, F.lit(")")))
    return F.when((n != "") & (t != ""), both).when(n != "", n).otherwise(t)


def legal_basis(found: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, basis): '- number: Điều 1, 2' per document in order of appearance, of the articles that the answer names; where
    it names none of them, of the first 10 sources; where it names no article at all, of the first 12.
    ``found``: query_id, rank, doc_number, document_title, article_number; ``answers``: query_id, answer."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(?iuU)điều\s*(\d+[a-zA-Z]?)"), F.lit(1)), lambda x: F.lower(x)))
    number = X.canonical_number("article_number")
    rows = found.withColumn("a", number).join(answers.select("query_id", named.alias("named")), "query_id")
    fits = F.coalesce(F.array_contains("named", F.lower("a")), F.lit(False)) | F.col("a").isNull()
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    some = F.max(fits.cast("int")).over(Window.partitionBy("query_id"))
    rows = rows.withColumns({"_fits": fits, "_n": nth, "_some": some})
    rows = rows.filter(F.when(F.size("named") == 0, F.col("_n") <= 12).when(F.col("_some") == 1, F.col("_fits")).otherwise(F.col("_n") <= 10))
    n = F.replace(F.trim(F.coalesce("doc_number", F.lit(""))), F.lit("_"), F.lit("/"))
    title = F.regexp_replace(F.trim(F.coalesce("document_title", F.lit(""))), r"\([^)]{100,}\)", "(…)")
    label = F.when(n != "", n).when(title == "", "Văn bản").when(F.length(title) > 220, F.concat(F.substring(title, 1, 217), F.lit("…"))).otherwise(title)
    key = F.when(n != "", X.normal_reference(n)).otherwise(F.lower(F.substring(F.trim(F.coalesce("document_title", F.lit(""))), 1, 120)))
    order = F.struct(F.coalesce(F.regexp_extract("a", r"^(\d+)", 1).try_cast("int"), F.lit(99999)).alias("n"), F.lower("a").alias("s"), F.col("a"))
    docs = rows.withColumns({"_key": key, "_label": label}).groupBy("query_id", "_key").agg(F.min("rank").alias("first"), F.min_by("_label", "rank").alias("label"), F.sort_array(F.collect_set(F.when(F.col("a").isNotNull(), order))).alias("as"))
    docs = docs.filter(F.lower("label") != "string")
    line = F.concat(F.lit("- "), "label", F.when(F.size("as") > 0, F.concat(F.lit(": Điều "), F.array_join(F.transform("as", lambda x: x["a"]), ", "))).otherwise(F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("first", "_key", line.alias("line")))), lambda x: x["line"])
    return docs.groupBy("query_id").agg(F.concat(F.lit(f"{BASIS}\n"), F.array_join(lines, "\n")).alias("basis"))


def with_basis(answer: Column, basis: Column) -> Column:
    """The answer with its legal basis at the end instead of one it ends with; a basis in its middle stays alone."""
    cut = without_basis(answer)
    middle = ~cut["cut"] & F.contains(F.lower(answer), F.lit(BASIS[:-1].lower()))
    return F.when(basis.isNull() | is_no_info(answer) | middle, answer).otherwise(F.concat(_cut(cut["text"]), F.lit("\n\n"), basis))


def with_numbers(answer: Column, labels: Column) -> Column:
    """Answers that name no document number list their sources' labels (12 at most)."""
    once = F.array_distinct(F.filter(labels, lambda x: x != ""))
    named = F.rlike(F.coalesce(answer, F.lit("")), F.lit(r"(?U)\b\d+/\d{4}/[A-ZĐa-zđ0-9\-]+\b"))
    tail = F.concat(F.lit("\n\nVăn bản xác định rõ số hiệu:\n"), F.array_join(F.transform(F.slice(once, 1, 12), lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.when(named | F.coalesce(F.size(once) <= 0, F.lit(True)), answer).otherwise(F.concat(_cut(F.coalesce(answer, F.lit(""))), tail))


def has_article_content(answer: Column) -> Column:
    """Whether an answer names an article and says something of at least 20 characters behind it."""
    return F.rlike(F.lower(F.coalesce(answer, F.lit(""))), F.lit(r"(?sU)\bđiều\s+\d+[a-z]?\b[\s:.\-–—]*.{20,}"))


def related_documents(found: DataFrame) -> DataFrame:
    """(query_id, answer): the list of related documents that stands in for an answer."""
    label = source_label(F.col("doc_number"), F.col("document_title"))
    once = found.withColumn("_l", label).filter("_l != ''").groupBy("query_id", F.lower("_l").alias("_k")).agg(F.min("rank").alias("first"), F.min_by("_l", "rank").alias("l"))
    lines = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("first", "l"))), 1, 12), lambda x: F.concat(F.lit("- "), x["l"]))
    return once.groupBy("query_id").agg(F.concat(F.lit(f"{HEADING}\n\nDanh sách văn bản liên quan:\n"), F.array_join(lines, "\n")).alias("answer"))


def follow_up(answer: Column, confidence: Column, has_sources: Column, texts: dict[str, str], low: float = 0.5) -> Column:
    """The answer with a closing question: by ``texts`` for no information, no sources, low confidence, else."""
    pick = F.when(is_no_info(answer), texts["no_info"]).when(~has_sources, texts["no_sources"]).when(F.coalesce(confidence, F.lit(0.0)) < low, texts["unsure"]).otherwise(texts["else"])
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", answer).otherwise(F.concat(_cut(answer), F.lit("\n\n---\n"), pick))


def legacy_source(s: str = "source") -> Column:
    """A source struct in the older nested form: content, and metadata without empty fields."""
    f = lambda name: F.col(f"{s}.{name}").cast("string")
    fields = {"law_name": "document_title", "doc_number": "doc_number", "article_number": "article_number", "article_title": "article_title", "document_id": "document_id"}
    meta = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), f(v))]), lambda k, v: v.isNotNull() & (v != ""))
    return F.struct(f("snippet").alias("content"), meta.alias("metadata"))


# Which passages an answer may use


def of_reference(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Passages whose number or title holds the reference that their question names; all where it names none."""
    ref = F.coalesce(F.nullif(F.regexp_extract("query", r"(\d+/\d{4}/[A-ZĐa-zđ0-9\-]+)", 1), F.lit("")), F.nullif(F.regexp_extract("query", r"(?iuU)(?:nghị\s*định|thông\s*tư|quyết\s*định|chỉ\s*thị|luật)\s+(?:số\s+)?(\d+/\d{4})", 1), F.lit("")))
    rows = passages.join(queries.select("query_id", X.normal_reference(ref).alias("_ref")), "query_id")
    holds = lambda c: F.contains(X.normal_reference(F.coalesce(c, F.lit(""))), F.col("_ref"))
    return rows.filter(F.col("_ref").isNull() | holds(F.col("doc_number")) | holds(F.col("document_title"))).drop("_ref")


def single_article(passages: DataFrame, queries: DataFrame, score: str = "score") -> DataFrame:
    """Passages of one article per question: the one asked for, else the best by score - for questions about fines
    without articles on authority, where others are left. Questions without numbered passages keep all."""
    asked = F.lower(F.nullif(F.regexp_extract("query", r"(?iuU)điều\s+(\d+[a-zA-Z]?)", 1), F.lit("")))
    q = queries.select("query_id", asked.alias("_asked"), G.question_flags(F.col("query"))["asks_fine"].alias("_fine"))
    rows = passages.join(q, "query_id").withColumn("_a", X.canonical_number("article_number"))
    group, query = Window.partitionBy("query_id", "_a"), Window.partitionBy("query_id")
    about = F.max(F.contains(F.lower(F.coalesce("article_title", F.lit(""))), F.lit("thẩm quyền")).cast("int")).over(group)
    rows = rows.withColumns({"_auth": about, "_best": F.max(score).over(group), "_hit": F.coalesce(F.lower("_a") == F.col("_asked"), F.lit(False))})
    other = F.max((F.col("_a").isNotNull() & (F.col("_auth") == 0)).cast("int")).over(query) == 1
    usable = F.col("_a").isNotNull() & ~(F.col("_fine") & other & (F.col("_auth") == 1))
    order = [F.col("_hit").desc(), F.col("_usable").desc(), F.col("_best").desc(), F.col("_a")]
    rows = rows.withColumn("_usable", usable)
    chosen = F.first("_a").over(query.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_chosen", chosen).filter("_chosen IS NULL OR _a = _chosen").drop("_asked", "_fine", "_a", "_auth", "_best", "_hit", "_usable", "_chosen")


def said_by_first(passages: DataFrame, n: int) -> DataFrame:
    """(query_id, said): titles and texts of a question's first n passages, lower-cased, as one text."""
    line = F.lower(F.concat_ws(" ", "document_title", "text"))
    return passages.filter(F.col("rank") <= n).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), " ").alias("said"))


def anchored(said: Column, anchors: Column) -> Column:
    """Whether any subject anchor stands in the passages; true without anchors."""
    return (F.size(anchors) == 0) | F.exists(anchors, lambda a: F.contains(said, a))


def on_topic(said: Column, terms: Column, weak: list[str]) -> Column:
    """Whether passages are on a question's topic: two terms that aren't weak, or one and two weak ones (three or more terms);
    one that isn't weak and in all two counting weak ones less one (two terms); any (one term); true without terms."""
    held = F.filter(terms, lambda t: F.contains(said, t))
    w = F.size(F.filter(held, lambda t: t.isin(*weak)))
    s = F.size(held) - w
    n = F.size(terms)
    return F.when(n == 0, True).when(n >= 3, (s >= 2) | ((s >= 1) & (w >= 2))).when(n == 2, (s >= 1) & (s + F.greatest(w - 1, F.lit(0)) >= 2)).otherwise(s + w >= 1)


def grounded(answers: DataFrame, contexts: DataFrame, embedder=None, least: float = 0.40) -> DataFrame:
    """(query_id, similarity, grounded): the best cosine of an answer with its contexts, by the embedder."""
    a = P.embedded(answers.select("query_id", F.col("answer").alias("text")), provider=embedder, name="va").drop("text")
    c = P.embedded(contexts.select("query_id", "text").filter("trim(text) != ''"), provider=embedder, name="vc").drop("text")
    best = a.join(c, "query_id").select("query_id", X.cosine(F.col("va"), F.col("vc")).alias("s")).groupBy("query_id").agg(F.max("s").alias("s"))
    return answers.select("query_id").join(best, "query_id", "left").select("query_id", F.round(F.coalesce("s", F.lit(0.0)), 4).alias("similarity"), (F.coalesce("s", F.lit(0.0)) >= least).alias("grounded"))


def judged(reply: Column) -> Column:
    """A checking model's verdict: its field ``grounded``; true where the reply isn't readable (permissive)."""
    inner = F.regexp_extract(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?i)^\s*```(?:json)?|```\s*$", ""), r"(?s)\{.*\}", 0)
    return F.coalesce(F.get_json_object(inner, "$.grounded").try_cast("boolean"), F.lit(True))


def draft_basis(draft: Column, references: Column, most: int = 8) -> Column:
    """A draft with a legal basis from the corpus: its own stays where references exist, loses its lines where none does; one is
    added where it is missing."""
    refs = F.slice(F.array_distinct(references), 1, most)
    low = F.lower(F.trim(draft))
    has = F.contains(low, F.lit(BASIS[:-1].lower())) | F.contains(low, F.lit("căn cứ:"))
    pattern = r"(?iu)(Căn cứ[^:]*:)\s*[\s\S]*?(?=\n\s*(?:I\.|II\.|III\.|1\.|MỤC ĐÍCH|NỘI DUNG|YÊU CẦU|Điều)|\z)"
    emptied = F.regexp_replace(F.trim(draft), pattern, "$1\n    (Cần bổ sung căn cứ pháp lý từ cơ sở dữ liệu)")
    section = F.concat(F.lit(f"\n\n{BASIS}\n"), F.array_join(F.transform(refs, lambda r: F.concat(F.lit("    "), r, F.lit(";"))), "\n"))
    some = F.size(refs) > 0
    return F.when(F.trim(draft) == "", F.trim(draft)).when(has & some, F.trim(draft)).when(has, emptied).when(some, F.concat(F.trim(draft), section)).otherwise(F.trim(draft))


# Submitted documents


def submitted_documents(query: Column) -> Column:
    """The documents that a question says were handed in: what follows 'đã nộp:' and the like, by commas and 'và'."""
    part = lambda p: F.nullif(F.regexp_extract(query, p, 1), F.lit(""))
    said = F.coalesce(part(r"(?iuU)(?:đã nộp|đã nhận|đã có|tôi có|tôi nộp|nộp)\s*:\s*(.+)"), part(r"(?iuU)(?:bao gồm|gồm có|gồm)\s*:\s*(.+)"), F.lit(""))
    return F.filter(F.transform(F.split(said, r"(?U)[,;]\s*|\s+và\s+"), lambda d: F.trim(d)), lambda d: d != "")


def document_id(name: Column, aliases: dict[str, list[str]]) -> Column:
    """The id of a document's name: the id itself, else the first one with an alias that holds the name or stands in it, else the
    name with underscores."""
    low = F.lower(F.trim(name))
    out = F.replace(low, F.lit(" "), F.lit("_"))
    for key, names in reversed(aliases.items()):
        hit = F.lit(False)
        for a in names:
            hit = hit | F.contains(low, F.lit(a)) | F.contains(F.lit(a), low)
        out = F.when(hit, key).otherwise(out)
    for key in aliases:
        out = F.when(low == key, key).otherwise(out)
    return out


def document_check(queries: DataFrame, procedures: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(query_id, name, required_documents, submitted, missing, complete) by each question's best procedure."""
    best = best_procedure(queries, procedures)
    handed = F.transform(submitted_documents(F.col("query")), lambda d: document_id(d, aliases))
    rows = best.withColumn("submitted", handed)
    return rows.select("query_id", "name", "required_documents", "submitted", missing_documents(F.col("submitted"), F.col("required_documents")).alias("missing")).withColumn("complete", F.size("missing") == 0)


def missing_documents(submitted: Column, required: Column) -> Column:
    return F.array_except(required, submitted)


def best_procedure(queries: DataFrame, procedures: DataFrame) -> DataFrame:
    """The procedure with most keywords in a query (first on ties), else one of whose name a longer word stands there."""
    q = F.lower("query")
    pairs = queries.join(small(procedures))
    hits = F.size(F.filter("keywords", lambda k: F.contains(q, F.lower(k))))
    name = F.exists(F.split(F.lower("name"), " "), lambda w: (F.length(w) > 2) & F.contains(q, w))
    scored = pairs.withColumns({"hits": hits, "tier": F.when(hits > 0, 1).when(name, 2)}).filter("tier IS NOT NULL")
    return R.first_by_key(scored, "query_id", [F.col("tier"), F.col("hits").desc(), F.col("ord")])
