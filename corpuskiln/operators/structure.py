"""Documents to chapters, sections, articles, clauses and chunks, as windows over lines.

A document's lines are rows; a header line starts an island, and what stands
above (chapter, section, article, clause) is carried down by running counts
within the document.  Patterns are parameters, the defaults read Vietnamese
legal texts.  Documents without any article header fall back to an outline of
numbered lines; documents with neither have no rows and are reported by
``rejected``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.operators import chunks as C


@dataclass(frozen=True)
class Patterns:
    appendix: str = r"(?iuU)^\s*(Phụ\s*lục|Mẫu\s*(?:số|biểu)?|Biểu\s*mẫu|Bảng)\b"
    table: str = r"(?U)^\s*[\wÀ-ỹ0-9()\-/.:]+(?:\s{2,}|\t+).+"
    chapter: str = r"(?iuU)^\s*Chương\s+([IVXLCDM]+|\d+)\b[.\-–:]*\s*(.*)$"
    section: str = r"(?iuU)^\s*Mục\s+(\d+[A-Za-z]?)\s*[.\-–:]?\s*(.*)$"
    article: str = r"(?iuU)^\s*(?:Điều|Dieu)\s*(\d+[A-Za-z]?)\s*[.\-–:]?\s*(.*)$"
    clause: str = r"(?iuU)^\s*(?:Khoản\s+)?(\d+[A-Za-z]?)\s*[.)]\s*(.*)$"
    point: str = r"(?iuU)^\s*([a-zđ])\s*[).]\s*(.*)$"
    inline_point: str = r"(?iuU)(?<=[;.:!])\s+([a-zđ])\s*\)\s+"
    #: Words from which on a line of columns is a table's.
    table_words: int = 7
    longest_title: int = 220


def _within(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no")


def _hit(c: Column | str, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _count(flag: Column, *keys: str) -> Column:
    return F.sum(flag.cast("long")).over(_within(*keys))


def lines_of(docs: DataFrame, p: Patterns = Patterns(), text: str = "text") -> DataFrame:
    """(document_id, line_no, line, kind flags and the islands each line is in); appendices are cut off."""
    split = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), p.inline_point, "\n$1) ")
    rows = docs.select("document_id", F.posexplode(F.split(split, "\n")).alias("line_no", "line"))
    columns = _hit("line", p.table) & (F.size(F.split(F.trim("line"), r"\s+")) >= p.table_words)
    rows = rows.filter(~columns).withColumn("line", F.trim("line")).filter("line != ''")
    rows = rows.withColumn("_cut", _count(_hit("line", p.appendix), "document_id")).filter("_cut = 0").drop("_cut")
    rows = rows.withColumn("outline", ~F.max(_hit("line", p.article)).over(Window.partitionBy("document_id")))
    article = F.when(F.col("outline"), _hit("line", p.clause)).otherwise(_hit("line", p.article))
    rows = rows.withColumns({"is_chapter": _hit("line", p.chapter), "is_section": _hit("line", p.section), "is_article": article})
    rows = rows.withColumns({"chapter_ord": _count(F.col("is_chapter"), "document_id"), "article_ord": _count(F.col("is_article"), "document_id")})
    rows = rows.withColumn("section_ord", _count(F.col("is_section"), "document_id", "chapter_ord"))  # a chapter resets it
    # an article's title stands in its header, or alone on the next line
    named = F.when(F.col("is_article"), F.when(F.col("outline"), F.regexp_extract("line", p.clause, 2)).otherwise(F.regexp_extract("line", p.article, 2)))
    rows = rows.withColumn("_title", named)
    before = F.lag(F.col("is_article") & (F.col("_title") == "")).over(_within("document_id"))
    plain = ~F.col("is_article") & ~F.col("is_chapter") & ~F.col("is_section") & ~_hit("line", p.clause) & ~_hit("line", p.point)
    rows = rows.withColumn("is_title", F.coalesce(before, F.lit(False)) & plain & (F.length("line") <= p.longest_title))
    body = ~F.col("is_article") & ~F.col("is_title") & ~F.col("is_chapter") & ~F.col("is_section") & (F.col("article_ord") > 0)
    rows = rows.withColumn("is_body", body)
    clause = F.col("is_body") & _hit("line", p.clause) & ~F.col("outline")
    rows = rows.withColumn("is_clause", clause).withColumn("clause_ord", _count(F.col("is_clause"), "document_id", "article_ord"))
    rows = rows.withColumn("is_point", F.col("is_body") & _hit("line", p.point))
    return rows.withColumn("point_ord", _count(F.col("is_point"), "document_id", "article_ord", "clause_ord"))


def _joined(where: Column, value: Column | str = "line") -> Column:
    """Lines of a group in order, as one text."""
    picked = F.sort_array(F.collect_list(F.when(where, F.struct("line_no", F.col(value).alias("line") if isinstance(value, str) else value.alias("line")))))
    return F.array_join(F.transform(picked, lambda x: x["line"]), "\n")


def chapters_of(lines: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """One row per distinct chapter number of a document; a repeated number keeps its first place."""
    heads = lines.filter("is_chapter").select("document_id", "line_no", F.upper(F.regexp_extract("line", p.chapter, 1)).alias("chapter_number"), F.regexp_extract("line", p.chapter, 2).alias("title"))
    one = heads.groupBy("document_id", "chapter_number").agg(F.min("line_no").alias("line_no"), F.min_by("title", "line_no").alias("title"))
    return one.withColumn("sort_order", F.row_number().over(_within("document_id"))).drop("line_no")


def articles_of(lines: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """(document_id, article_ord, chapter_number, section_number, article_number, title, content)."""
    chapter = F.last(F.when(F.col("is_chapter"), F.upper(F.regexp_extract("line", p.chapter, 1))), ignorenulls=True).over(_within("document_id"))
    section = F.last(F.when(F.col("is_section"), F.regexp_extract("line", p.section, 1)), ignorenulls=True).over(_within("document_id", "chapter_ord"))
    number = F.when(F.col("outline"), F.regexp_extract("line", p.clause, 1)).otherwise(F.regexp_extract("line", p.article, 1))
    rows = lines.withColumns({"_chapter": chapter, "_section": section}).filter("article_ord > 0")
    head = lambda c: F.max(F.when(F.col("is_article"), c))
    title = F.coalesce(F.nullif(head(F.col("_title")), F.lit("")), F.max(F.when(F.col("is_title"), F.col("line"))), F.lit(""))
    return rows.groupBy("document_id", "article_ord").agg(
        head(F.col("_chapter")).alias("chapter_number"), head(F.col("_section")).alias("section_number"),
        F.concat(F.lit("Điều "), head(number)).alias("article_number"), title.alias("title"), _joined(F.col("is_body")).alias("content"),
    )


def clauses_of(lines: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """Clauses and points as rows: (document_id, article_ord, clause_ord, clause_number, kind, content).
    A line under a point belongs to the point and to its clause, so it is dealt to both, in one pass."""
    none = F.lit(0).cast("long")

    def member(kind: str, word: str, point: Column, heads: Column, pattern: str) -> Column:
        number = F.when(heads, F.concat(F.lit(word), F.regexp_extract("line", pattern, 1)))
        text = F.when(heads, F.regexp_extract("line", pattern, 2)).otherwise(F.col("line"))
        return F.struct(F.lit(kind).alias("kind"), point.alias("point"), number.alias("number"), text.alias("text"))

    clause = F.when(F.col("clause_ord") > 0, member("clause", "Khoản ", none, F.col("is_clause"), p.clause))
    point = F.when(F.col("point_ord") > 0, member("point", "Điểm ", F.col("point_ord"), F.col("is_point"), p.point))
    dealt = lines.filter("is_body").select("document_id", "article_ord", "clause_ord", "line_no", F.explode(F.array_compact(F.array(clause, point))).alias("m"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "m.text"))), lambda x: x["text"]), "\n")
    grouped = dealt.groupBy("document_id", "article_ord", "clause_ord", F.col("m.point").alias("point"), F.col("m.kind").alias("kind"))
    return grouped.agg(F.max("m.number").alias("clause_number"), joined.alias("content")).select("document_id", "article_ord", "clause_ord", "clause_number", "kind", "content")


def chunks_of(articles: DataFrame, clauses: DataFrame, titles: DataFrame) -> DataFrame:
    """Three tiers: whole articles, their clauses (points only where there is no clause), and
    512-word windows of whatever is longer, right behind it."""
    t = titles.select("document_id", F.col("title").alias("document_title"))
    a = articles.join(t, "document_id", "left")
    head = F.concat(F.col("article_number"), F.when(F.col("title") != "", F.concat(F.lit(". "), F.col("title"))).otherwise(""))
    whole = a.select("document_id", "article_ord", F.lit(None).cast("string").alias("clause_number"), F.lit("article").alias("chunk_type"), F.concat_ws("\n", F.nullif("document_title", F.lit("")), head, F.nullif("content", F.lit(""))).alias("text"))
    has = F.max(F.col("kind") == "clause").over(Window.partitionBy("document_id", "article_ord"))
    fine = clauses.withColumn("_has", has).filter("kind = 'clause' OR NOT _has").drop("_has")
    small = fine.join(a.select("document_id", "article_ord", "article_number", "document_title"), ["document_id", "article_ord"])
    small = small.select("document_id", "article_ord", "clause_number", F.lit("clause").alias("chunk_type"), F.trim(F.concat_ws("\n", F.nullif("document_title", F.lit("")), "article_number", "clause_number", "content")).alias("text"))
    every = whole.unionByName(small).withColumn("_w", C.words_of("text"))
    last = F.ceil((F.size("_w") - C.SIZE) / F.lit(float(C.STEP))).cast("int")
    part = lambda i: F.struct(F.concat_ws(".sub.", F.coalesce("clause_number", F.lit("1")), i + 1).alias("clause_number"), F.lit("token_sub").alias("chunk_type"), F.array_join(F.slice("_w", i * C.STEP + 1, C.SIZE), " ").alias("text"))
    own = F.array(F.struct("clause_number", "chunk_type", "text"))
    parts = F.when(F.size("_w") > C.SIZE, F.concat(own, F.transform(F.sequence(F.lit(0), last), part))).otherwise(own)
    return every.select("document_id", "article_ord", F.explode(parts).alias("c")).select("document_id", "article_ord", "c.*")


def trimmed(content: Column | str, p: Patterns = Patterns()) -> Column:
    """An article's or clause's text up to a line, not its first, that opens another article or chapter."""
    c = F.col(content) if isinstance(content, str) else content
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    cut = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i > 0) & (_hit(F.get(lines, i), p.article) | _hit(F.get(lines, i), p.chapter)))
    return X.strip(F.array_join(F.slice(lines, 1, F.coalesce(F.get(cut, F.lit(0)), F.size(lines))), "\n"))


def segments(content: Column | str, points: bool = True, p: Patterns = Patterns()) -> Column:
    """An article's text in pieces, a new one at each line that opens a chapter, article, clause or (``points``) point."""
    c = F.col(content) if isinstance(content, str) else content
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    opens = lambda ln: _hit(ln, p.article) | _hit(ln, p.chapter) | _hit(ln, p.clause) | (_hit(ln, p.point) if points else F.lit(False))
    marked = F.array_join(F.transform(lines, lambda ln: F.when(opens(ln), F.concat(F.lit("\u0001"), ln)).otherwise(ln)), "\n")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: X.strip(x)), lambda x: x != "")


def linked(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with ids (hashes of what a row stands for, so a rerun finds the same ones) and references: articles to
    chapters and sections, clauses to articles, chunks to articles and to the clause they are from.  Where a number
    occurs twice in a document, the last article of that number is the one that chunks are linked to."""
    chapters = tables["chapters"].select("document_id", F.xxhash64("document_id", "chapter_number").alias("chapter_id"), "chapter_number", "title", "sort_order")
    articles = tables["articles"].withColumn("article_id", F.xxhash64("document_id", "article_ord"))
    chapter = F.when(F.col("chapter_number").isNotNull(), F.xxhash64("document_id", "chapter_number"))
    section = F.when(F.col("section_number").isNotNull(), F.xxhash64("document_id", F.coalesce("chapter_number", F.lit("")), F.lit("section"), "section_number"))
    articles = articles.withColumns({"chapter_id": chapter, "section_id": section})
    first = articles.filter("section_id IS NOT NULL").groupBy("section_id", "chapter_id", "document_id", "section_number").agg(F.min("article_ord").alias("first"))
    sections = first.withColumn("sort_order", F.row_number().over(Window.partitionBy("document_id", "chapter_id").orderBy("first"))).drop("first")
    last = articles.groupBy("document_id", "article_number").agg(F.max_by("article_id", "article_ord").alias("link_id"))
    clauses = tables["clauses"].withColumns({"article_id": F.xxhash64("document_id", "article_ord"), "clause_id": F.xxhash64("document_id", "article_ord", "clause_ord", "clause_number", "kind")})
    numbered = tables["chunks"].join(articles.select("document_id", "article_ord", "article_number"), ["document_id", "article_ord"]).join(last, ["document_id", "article_number"])
    parent = F.regexp_replace(F.coalesce("clause_number", F.lit("")), r"\.sub\.\d+$", "")
    named = F.when(parent == "1", "Khoản 1").otherwise(parent)
    known = clauses.groupBy(F.col("article_id").alias("link_id"), F.col("clause_number").alias("parent")).agg(F.min("clause_id").alias("clause_id"))
    chunks = numbered.withColumn("parent", named).join(known, ["link_id", "parent"], "left").withColumnRenamed("link_id", "article_id").drop("parent")
    chunks = chunks.withColumn("chunk_id", F.xxhash64("document_id", "article_ord", F.coalesce("clause_number", F.lit("")), "chunk_type", "text"))
    return {**tables, "chapters": chapters, "sections": sections, "articles": articles, "clauses": clauses, "chunks": chunks}


def chunk_metrics(chunks: DataFrame) -> DataFrame:
    """(document_id, n_chunks, mean_chars) per document."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"))


def rejected(docs: DataFrame, articles: DataFrame) -> DataFrame:
    return docs.select("document_id").join(articles.select("document_id").distinct(), "document_id", "left_anti").withColumn("reason", F.lit("no articles"))


def parsed(docs: DataFrame, p: Patterns = Patterns(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All tables of documents; ``keep`` is applied to what several of them read (writing it, for instance)."""
    lines = keep(lines_of(docs, p))
    articles, clauses = keep(articles_of(lines, p)), keep(clauses_of(lines, p))
    titles = docs.select("document_id", "title") if "title" in docs.columns else docs.select("document_id", F.lit("").alias("title"))
    return {"chapters": chapters_of(lines, p), "articles": articles, "clauses": clauses, "chunks": chunks_of(articles, clauses, titles), "errors": rejected(docs, articles)}
