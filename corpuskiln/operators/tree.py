"""Documents as trees: chapters, articles, clauses, points, read line by line by a table function.

What a line is (a header of some kind or none) is found by column expressions.  Which
block it belongs to depends on what came before, so that is a state machine: the table
function ``Blocks`` over a document's lines in order holds a few labels and counters,
never the lines.  It serves two kinds of documents: those with article headers, where
an article runs to the next header and its title may stand alone on the next line, and
those without, where chapters, sections, headings and numbered lines open blocks that are
numbered as they come.  A numbered line opens one only behind more than ``SHORT`` lines, or
lists would fall apart.  Blocks without a body are left out of outlines.

Registered as ``parse_tree`` it is SQL: ``SELECT * FROM parse_tree(TABLE(lines) PARTITION
BY document_id ORDER BY line_no)``, with lines as ``read_lines`` makes them.

Defined cases: null and blank documents have no blocks; what stands above the first
header is no article's; everything from an appendix header on, and lines of columns, is left
out; equal chapter numbers are one chapter with the last title; a document without chapters
gets an empty one that holds all its articles.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.functions import text as X
from corpuskiln.operators.structure import Patterns, segments, trimmed

#: Lines that a block must have before a numbered line opens the next one.
SHORT = 2
#: Headings of outlines, and numbered lines.
HEADING = r"(?iuU)^\s*(Chương\s*trình|Nội\s*dung|Mục\s*tiêu|Phần)\b\s*[:\-]?\s*(.*)$"
NUMBERED = r"(?U)^\s*(\d{1,3})\s*[.)]\s*(.+)$"

_BLOCK = "document_id long, line_no int, block int, role string, number string, title string, chapter string, section string, line string"


class Blocks:
    """One document's lines in, the same lines with their block out; role is head, title or body."""

    def __init__(self) -> None:
        self.block = self.length = 0
        self.chapter = self.section = ""
        self.untitled = False  # the line behind an article header may be its title

    def _opened(self, row: Row, number: str, title: str) -> tuple:
        self.block, self.length, self.untitled = self.block + 1, 0, False
        return (row.document_id, row.line_no, self.block, "head", number, title, self.chapter, self.section, None)

    def _said(self, row: Row, role: str = "body") -> tuple:
        self.length += 1
        return (row.document_id, row.line_no, self.block, role, None, None, None, None, row.line)

    def eval(self, row: Row) -> Iterator[tuple]:
        yield from (self._outline if row.outline else self._article)(row)

    def _labels(self, row: Row) -> str | None:
        """Takes a chapter's or section's label over and returns it."""
        if row.kind == "chapter":
            self.chapter, self.section = row.label, ""
        elif row.kind in ("section", "heading"):
            self.section = row.label
        else:
            return None
        return row.label

    def _article(self, row: Row) -> Iterator[tuple]:
        if row.kind == "article":
            yield self._opened(row, row.number, row.label)
            self.untitled = not row.label
            return
        may_be_title, self.untitled = self.untitled, False
        if row.kind != "heading":
            self._labels(row)
        if self.block:
            plain = row.kind in ("", "heading") and not row.opens and row.line != ""
            yield self._said(row, "title" if may_be_title and plain and row.short else "body")

    def _outline(self, row: Row) -> Iterator[tuple]:
        label = self._labels(row)
        if label is not None:
            yield self._opened(row, "", label)
            return
        if row.line and (not self.block or row.numbered and self.length > SHORT):
            yield self._opened(row, "", row.line[:220] if row.numbered else "")
        if self.block:
            yield self._said(row)


def blocks_udtf():
    return F.udtf(Blocks, returnType=_BLOCK)


def register(spark: SparkSession, name: str = "parse_tree") -> None:
    """Makes the table function known to SQL."""
    spark.udtf.register(name, blocks_udtf())


def read_lines(docs: DataFrame, p: Patterns = Patterns(), text: str = "text") -> DataFrame:
    """(document_id, line_no, line, kind, number, label, opens, numbered, short, outline): a row a line, without appendices
    and lines of columns; ``outline`` where a document has no article header."""
    hit = lambda pattern: F.rlike("line", F.lit(pattern))
    part = lambda pattern, i: F.trim(F.regexp_extract("line", pattern, i))
    named = lambda word, pattern: F.concat_ws(" - ", F.concat(F.lit(word + " "), F.upper(part(pattern, 1)) if word == "Chương" else part(pattern, 1)), F.nullif(part(pattern, 2), F.lit("")))
    raw = docs.select("document_id", F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")).alias("line_no", "raw"))
    raw = raw.withColumn("line", X.strip("raw"))
    order = Window.partitionBy("document_id").orderBy("line_no")
    cut = F.max(hit(p.appendix)).over(order)
    columns = F.rlike("raw", F.lit(p.table)) & (F.size(F.split("line", r"\s+")) >= p.table_words)
    rows = raw.withColumn("_cut", cut).filter(~F.col("_cut") & ~columns)
    kind = F.when(hit(p.chapter), "chapter").when(hit(p.section), "section").when(hit(p.article), "article").when(hit(HEADING), "heading").otherwise("")
    rows = rows.withColumn("kind", kind)
    heading = F.concat_ws(": ", part(HEADING, 1), F.nullif(part(HEADING, 2), F.lit("")))
    label = F.when(F.col("kind") == "chapter", named("Chương", p.chapter)).when(F.col("kind") == "section", named("Mục", p.section)).when(F.col("kind") == "article", part(p.article, 2)).when(F.col("kind") == "heading", heading).otherwise("")
    return rows.select(
        "document_id", "line_no", "line", "kind", F.when(F.col("kind") == "article", part(p.article, 1)).otherwise("").alias("number"), label.alias("label"),
        (hit(p.clause) | hit(p.point)).alias("opens"), hit(NUMBERED).alias("numbered"), (F.length("line") <= p.longest_title).alias("short"),
        (~F.max(F.col("kind") == "article").over(Window.partitionBy("document_id"))).alias("outline"),
    )


def _pieces(lines: Column, opens: str) -> Column:
    """Trimmed stretches of lines from one that opens to before the next."""
    marked = F.array_join(F.transform(lines, lambda ln: F.when(F.rlike(ln, F.lit(opens)), F.concat(F.lit("\u0001"), ln)).otherwise(ln)), "\n")
    parts = F.split(marked, "\u0001")
    return F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: X.strip(x)), lambda x: x != "")


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n"), lambda ln: X.strip(ln))


def points(content: Column, p: Patterns = Patterns()) -> Column:
    """array<struct(letter, content)> of a clause's text; points may follow one another on a line."""
    found = _pieces(_lines(F.regexp_replace(content, p.inline_point, "\n$1) ")), p.point)
    return F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(F.substring_index(x, "\n", 1), p.point, 1)).alias("letter"), x.alias("content")))


def clauses(content: Column, p: Patterns = Patterns()) -> Column:
    """array<struct(number, content, points)> of an article's text."""
    return F.transform(_pieces(_lines(content), p.clause), lambda x: F.struct(F.regexp_extract(F.substring_index(x, "\n", 1), p.clause, 1).alias("number"), x.alias("content"), points(x, p).alias("points")))


def blocks(docs: DataFrame, p: Patterns = Patterns(), text: str = "text") -> DataFrame:
    """The lines of ``docs`` (document_id, text) with their block, by the table function."""
    lines = read_lines(docs, p, text)
    return blocks_udtf()(lines.asTable().partitionBy("document_id").orderBy("line_no"))


def articles(docs: DataFrame, p: Patterns = Patterns(), text: str = "text") -> DataFrame:
    """(document_id, article_ord, outline, number, label, title, chapter, section, content, clauses): a row an article."""
    rows = blocks(docs, p, text)
    head = lambda c: F.max(F.when(F.col("role") == "head", F.col(c)))
    body = F.sort_array(F.collect_list(F.when(F.col("role") == "body", F.struct("line_no", "line"))))
    own = rows.groupBy("document_id", "block").agg(
        head("number").alias("number"), head("title").alias("named"), F.max(F.when(F.col("role") == "title", F.col("line"))).alias("below"),
        head("chapter").alias("chapter"), head("section").alias("section"), F.transform(body, lambda x: x["line"]).alias("lines"),
    )
    own = own.withColumns({"outline": F.col("number") == "", "content": X.strip(F.array_join("lines", "\n"))}).filter("NOT outline OR content != ''")
    first = F.coalesce(F.get("lines", F.lit(0)), F.lit(""))
    title = F.coalesce(F.nullif("named", F.lit("")), F.col("below"), F.when(F.col("outline") & (F.length(first) <= p.longest_title), first), F.lit(""))
    numbered = own.withColumn("article_ord", F.row_number().over(Window.partitionBy("document_id").orderBy("block")))
    number = F.when(F.col("outline"), F.col("article_ord").cast("string")).otherwise(F.col("number"))
    label = F.concat(F.when(F.col("outline"), "Mục ").otherwise("Điều "), number)
    return numbered.select("document_id", "article_ord", "outline", number.alias("number"), label.alias("label"), title.alias("title"), "chapter", "section", "content", clauses(F.col("content"), p).alias("clauses"))


def chapters(docs: DataFrame, found: DataFrame, p: Patterns = Patterns(), text: str = "text") -> DataFrame:
    """(document_id, chapter_number, title, sort_order, articles): each chapter with the places of its articles (``found``); an
    empty one for documents with articles but no chapter."""
    heads = read_lines(docs, p, text).filter("kind = 'chapter'")
    number = lambda c: F.upper(F.regexp_extract(c, r"(?iuU)^Chương\s+([IVXLCDM]+|\d+)\b", 1))
    named = heads.select("document_id", "line_no", number("label").alias("chapter_number"), F.regexp_extract("label", r"(?siU)^.*? - (.*)$", 1).alias("title"))
    one = named.groupBy("document_id", "chapter_number").agg(F.min("line_no").alias("first"), F.max_by("title", "line_no").alias("title"))
    held = found.select("document_id", number("chapter").alias("chapter_number"), "article_ord")
    of = held.groupBy("document_id", "chapter_number").agg(F.sort_array(F.collect_list("article_ord")).alias("articles"))
    none = F.array().cast("array<int>")
    real = one.join(of, ["document_id", "chapter_number"], "left").withColumn("sort_order", F.row_number().over(Window.partitionBy("document_id").orderBy("first")))
    bare = held.join(one.select("document_id").distinct(), "document_id", "left_anti").groupBy("document_id").agg(F.sort_array(F.collect_list("article_ord")).alias("articles"))
    cols = ["document_id", "chapter_number", "title", "sort_order", "articles"]
    bare = bare.select("document_id", F.lit("").alias("chapter_number"), F.lit("").alias("title"), F.lit(1).alias("sort_order"), "articles")
    return real.withColumn("articles", F.coalesce("articles", none)).select(*cols).unionByName(bare.select(*cols))


def clause_rows(found: DataFrame, p: Patterns = Patterns()) -> DataFrame:
    """(document_id, article_ord, place, clause_number, content): the rows of clauses and points.  A long clause is cut into pieces
    n, n.2, ...; an article without clauses is clause 1 in the same way; points follow as rows of their own."""

    def rows(number: Column, content: Column) -> Column:
        base = trimmed(content, p)

        def cut(found: Column) -> Column:
            some = F.when(F.size(found) > 0, found).otherwise(F.array(base))
            name = lambda i: F.concat_ws(".", F.concat(F.lit("Khoản "), number), F.when(i > 0, (i + 1).cast("string")))
            return F.transform(some, lambda x, i: F.struct(name(i).alias("clause_number"), x.alias("content")))

        said = F.transform(points(base, p), lambda x: F.struct(F.concat(F.lit("Điểm "), x["letter"]).alias("clause_number"), x["content"].alias("content")))
        return F.concat(X.let(segments(base, True, p), cut), said)

    every = F.when(F.size("clauses") > 0, F.flatten(F.transform("clauses", lambda c: rows(c["number"], c["content"])))).otherwise(rows(F.lit("1"), F.col("content")))
    return found.select("document_id", "article_ord", F.posexplode(every).alias("place", "c")).select("document_id", "article_ord", "place", "c.*")
