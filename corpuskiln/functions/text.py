"""Text expressions shared by the operators; all are plain column expressions.

Patterns say what they mean for any script: ``(?U)`` makes ``\\w`` and case
folding follow Unicode, because plain Java classes are ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a token is.
TOKEN = "[a-zA-ZÀ-ỹ0-9]+"
WORD = r"(?U)\w+"


def _bare(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))


#: Lower-case Latin letters with marks and what they are without; đ has no decomposition and is d.
_LATIN = [chr(i) for block in ((0xC0, 0x250), (0x1E00, 0x1F00)) for i in range(*block)]
_MARKED = {c: _bare(c) for c in _LATIN if c == c.lower() and len(_bare(c)) == 1 and _bare(c) != c} | {"đ": "d"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without diacritics, composed or combining; đ becomes d."""
    bare = F.translate(F.lower(col(c)), "".join(_MARKED), "".join(_MARKED.values()))
    return F.when(F.rlike(bare, F.lit(r"\p{M}")), F.regexp_replace(bare, r"\p{M}+", "")).otherwise(bare)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def strip(c: Column | str) -> Column:
    """Without blanks and line ends at both ends."""
    return F.btrim(col(c), F.lit(" \n\t\r"))


def tokens(c: Column | str, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(pattern), F.lit(0))


def token_set(c: Column | str, pattern: str = TOKEN) -> Column:
    return F.array_distinct(tokens(c, pattern))


def keywords(c: Column | str, stopwords: Iterable[str] = (), least: int = 2) -> Column:
    """Distinct lower-cased words, without stopwords and shorter ones, in order of appearance."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(token_set(c, WORD), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


#: Expressions of several words that are one keyword.
COMPOUNDS = (r"Điều\s+\d+", r"Khoản\s+\d+", r"Nghị\s+định", r"Thông\s+tư", r"Quyết\s+định", r"Luật\s+\w+")


def legal_keywords(c: Column | str, stopwords: Iterable[str] = ()) -> Column:
    """``keywords`` and, behind them, legal expressions of several words."""
    several = [F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("(?iuU)" + p), F.lit(0)), lambda m: F.lower(m)) for p in COMPOUNDS]
    return F.array_distinct(F.concat(keywords(c, stopwords), *several))


def like_terms(c: Column | str, stopwords: Iterable[str] = (), phrases: Iterable[str] = (), most: int = 12) -> Column:
    """The ``most`` longest of a question's keywords and of the phrases it holds: what a content search asks for."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases])) if phrases else F.array().cast("array<string>")
    terms = F.array_distinct(F.concat(legal_keywords(c, stopwords), held))
    order = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(order, lambda x: x["t"]), 1, most)


def share_of(part: Column, whole: Column) -> Column:
    """|part ∩ whole| / |part|, 0 when part is empty."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


def title_similarity(query: Column, title: Column) -> Column:
    """Share of a title's tokens that the query has."""
    return share_of(title, query)


def keyword_overlap(query: Column, text: Column) -> Column:
    """Share of a query's tokens that the text has."""
    return share_of(query, text)


def any_term(text: Column | str, terms: Column) -> Column:
    low = F.lower(col(text))
    return F.exists(terms, lambda t: F.contains(low, t))


def hit_share(text: Column | str, terms: Column, first: int | None = None) -> Column:
    """Share of terms contained in the text (its first characters), case-insensitively."""
    low = F.lower(F.substring(col(text), 1, first) if first else col(text))
    return F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.greatest(F.size(terms), F.lit(1))


def canonical_number(c: Column | str) -> Column:
    """'Điều 12a' -> '12a'; without a digit the trimmed value itself."""
    found = F.regexp_extract(col(c), r"(\d+[a-zA-Z]?)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.trim(col(c)))


def normal_reference(c: Column | str) -> Column:
    """Document numbers made comparable: underscores as slashes, folded, trimmed."""
    return F.trim(F.replace(fold(c), F.lit("_"), F.lit("/")))


def references(c: Column | str, pattern: str = r"\d{1,4}/\d{4}/[A-ZĐ]+(?:-[A-ZĐ0-9]+)*") -> Column:
    """All distinct document numbers of a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(0)))


def fine_label(c: Column | str, aliases: dict[str, str], default: str | None = None) -> Column:
    """A label mapped through aliases; unknown ones stay, or take the default."""
    low = F.lower(F.trim(col(c)))
    out = F.coalesce(F.lit(default), low) if default else low
    for old, new in aliases.items():
        out = F.when(low == old, new).otherwise(out)
    return out


def length_bucket(c: Column, edges: Iterable[int] = (40, 80, 120, 200)) -> Column:
    """'0-39', '40-79', ..., '200+'."""
    edges = list(edges)
    out, low = None, 0
    for edge in edges:
        name = F.lit(f"{low}-{edge - 1}")
        out = F.when(c < edge, name) if out is None else out.when(c < edge, name)
        low = edge
    return out.otherwise(F.lit(f"{low}+"))


def placeholder_to_null(c: Column | str, names: Iterable[str] = ("", "string", "null", "none", "undefined", "n/a", "na", "-")) -> Column:
    return F.when(F.lower(F.trim(col(c))).isin(*names), F.lit(None)).otherwise(col(c))


def safe_date(day: Column, month: Column, year: Column) -> Column:
    """A date, or null when there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def spoken_date(c: Column | str, first: int = 5000, pattern: str = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})") -> Column:
    """The first date written out in the beginning of a text."""
    head = F.substring(col(c), 1, first)
    return safe_date(*(F.nullif(F.regexp_extract(head, pattern, k), F.lit("")) for k in (1, 2, 3)))


def year_in(c: Column | str) -> Column:
    return F.try_cast(F.nullif(F.regexp_extract(col(c), r"/(\d{4})/", 1), F.lit("")), "int") if hasattr(F, "try_cast") else F.nullif(F.regexp_extract(col(c), r"/(\d{4})/", 1), F.lit("")).try_cast("int")


def safe_filename(c: Column | str, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(col(c)), r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"\s+", " "), 1, most)


#: What text recognition makes of words, and the words.
RECOGNISED = (
    ("ĐỔ#", "ĐỔI"), (r"\bQUYẾTĐỊNH\b", "QUYẾT ĐỊNH"), (r"\bNGHỊĐỊNH\b", "NGHỊ ĐỊNH"), (r"\bTHÔNGTƯ\b", "THÔNG TƯ"), (r"\bBỘTRƯỞNG\b", "BỘ TRƯỞNG"),
    (r"\bBỘVĂN\b", "BỘ VĂN"), ("CHƯ>", "CHƯƠNG"), ("Đ6ều", "Điều"), ("Điề6", "Điều"), ("Điề-", "Điều"), ("ĐIỀ-", "ĐIỀU"), (r"\bD[i1]ều\b", "Điều"),
    (r"\b[ĐÐ]i[eê]u\b", "Điều"), (r"\bChuong\b", "Chương"),
)
#: Lines of headers and footers, and words of signature lines.
HEADER_LINES = (
    r"Trang\s+\d+(\s*/\s*\d+)?", r"Page\s+\d+(\s*/\s*\d+)?", r"[-–—]?\s*\d+\s*[-–—]?", r"CỘNG\s+HÒA\s+XÃ\s+HỘI\s+CHỦ\s+NGHĨA\s+VIỆT\s+NAM",
    r"Độc\s+lập\s*-\s*Tự\s+do\s*-\s*Hạnh\s+phúc", "_{3,}", r"\.{4,}",
)
SIGNATURES = ("nơi nhận", "tm.", "kt.", "tuq.", "tl.", "ký tên", "đã ký")


def composed(c: Column | str) -> Column:
    """Unicode's composed form (NFC), in Arrow batches; a text that has it already is given back as it is."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))

    return nfc(col(c))


def normalised(c: Column | str) -> Column:
    """Line ends, control characters, escapes, recognition errors, dashes and blanks of an (NFC) text put right."""
    out = F.regexp_replace(col(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\\[abtnfrv]", " "), r"\\[a-zA-Z]+", "")
    for wrong, right in RECOGNISED:
        out = F.regexp_replace(out, "(?U)" + wrong, right)
    out = F.regexp_replace(F.regexp_replace(out, "[–—]", "-"), r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n"))


def without_headers(c: Column | str, shorter: int = 140) -> Column:
    """Lines of headers, footers and (short ones) signatures removed."""
    drop = r"(?iuU)^\s*(?:" + "|".join(HEADER_LINES) + r")\s*$"
    sign = "|".join(s.replace(".", "[.]") for s in SIGNATURES)
    kept = F.filter(F.split(col(c), "\n"), lambda ln: ~F.rlike(ln, F.lit(drop)) & ~(F.rlike(F.lower(ln), F.lit(sign)) & (F.length(F.trim(ln)) < shorter)))
    return F.array_join(kept, "\n")


def article_blocks(c: Column | str, most: int = 500) -> Column:
    """The blocks of a text that open with an article header of number 1..``most``; what stands before the first is left out."""
    parts = F.split(col(c), r"(?imuU)^(?=\s*Điều\s+\d+)")
    number = lambda b: F.regexp_extract(b, r"(?iuU)^\s*Điều\s+(\d+)", 1).try_cast("int")
    return F.transform(F.filter(parts, lambda b: F.coalesce(number(b).between(1, most), F.lit(False))), lambda b: strip(b))


def decision_intro(c: Column | str) -> Column:
    """What a decision says from its line 'QUYẾT ĐỊNH:' to its first article or the end; null without that line."""
    return F.nullif(strip(F.regexp_extract(col(c), r"(?siuU)(?:^|\n)\s*(QUYẾT\s+ĐỊNH\s*:.*?)(?=\n\s*Điều\s+\d+\b|\z)", 1)), F.lit(""))


def cleaned(c: Column | str) -> Column:
    """Normalised, without headers, blanks collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(without_headers(normalised(c)), r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def preprocessed(c: Column | str) -> Column:
    """Normalised, without headers, and where article blocks are found, rebuilt from intro and blocks."""
    def rebuilt(clean: Column) -> Column:
        return let(article_blocks(clean), lambda blocks: F.when(F.size(blocks) > 0, F.concat_ws("\n\n", decision_intro(clean), blocks)).otherwise(clean))

    return let(cleaned(c), rebuilt)


def without_controls(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def clean_lines(c: Column | str, drop: str, hint: str | None = None, shorter: int = 140) -> Column:
    """Blank runs collapsed; lines matching ``drop`` and short ones matching ``hint`` removed."""
    text = F.regexp_replace(F.regexp_replace(col(c), r"\r\n?", "\n"), r"[ \t]+", " ")
    kept = F.filter(
        F.split(text, "\n"),
        lambda ln: ~F.rlike(ln, F.lit(drop)) & (~(F.rlike(ln, F.lit(hint)) & (F.length(ln) < shorter)) if hint else F.lit(True)),
    )
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


#: Fixed value: a document's number as an answer cites it.
CITED = r"(?U)\b(\d+[/_]\d{4}[/_][A-ZĐa-zđ\-]+)\b"


def supported_lines(answer: Column | str, context: Column | str, pattern: str = CITED, normal: Callable[[Column], Column] = normal_reference) -> Column:
    """An answer without the lines that cite what the context doesn't; null when none is left. What is cited is compared
    in its normal form.  A context that cites nothing says nothing about the answer, which then stays as it is, like
    one whose citations all stand in the context."""
    found = lambda c: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: normal(m))
    known = found(F.coalesce(col(context), F.lit("")))

    def kept(known: Column) -> Column:
        lines = F.split(col(answer), "\n")
        good = F.filter(lines, lambda ln: F.size(F.array_except(found(ln), known)) == 0)
        rest = strip(F.regexp_replace(F.array_join(good, "\n"), r"\n{3,}", "\n\n"))
        return F.when((F.size(known) == 0) | (F.size(good) == F.size(lines)), col(answer)).otherwise(F.nullif(rest, F.lit("")))

    return let(known, kept)


def json_object(c: Column | str) -> Column:
    """The first {...} of a model's reply, without code fences; null when it isn't JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit("")))


def cache_key(c: Column | str, prefix: str = "legal_chat:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.lower(F.trim(col(c))), 256), 1, 16))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays in doubles (cosine when both have norm 1)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(cosine(a, a))
