"""The line-by-line parser against a plain one, on made-up documents."""

import random
import re

import pytest

from corpuskiln.operators import structure, tree

CHAPTER = re.compile(r"^Chương\s+([IVXLCDM]+|\d+)\b[.\-–:]*\s*(.*)$", re.I)
SECTION = re.compile(r"^Mục\s+(\d+[A-Za-z]?)\s*[.\-–:]?\s*(.*)$", re.I)
HEADING = re.compile(r"^(Chương\s*trình|Nội\s*dung|Mục\s*tiêu|Phần)\b\s*[:\-]?\s*(.*)$", re.I)
ARTICLE = re.compile(r"^(?:Điều|Dieu)\s*(\d+[A-Za-z]?)\s*[.\-–:]?\s*(.*)$", re.I)
CLAUSE = re.compile(r"^(?:Khoản\s+)?(\d+[A-Za-z]?)\s*[.)]\s*(.*)$", re.I)
POINT = re.compile(r"^([a-zđ])\s*[).]\s*(.*)$", re.I)
NUMBERED = re.compile(r"^(\d{1,3})\s*[.)]\s*(.+)$")
APPENDIX = re.compile(r"^(Phụ\s*lục|Mẫu\s*(?:số|biểu)?|Biểu\s*mẫu|Bảng)\b", re.I)


def plain_articles(text):
    """[(label, title, chapter, section, content)] by reading the whole document at once."""
    lines = [ln.strip() for ln in (text or "").split("\n")]
    cut = next((i for i, ln in enumerate(lines) if APPENDIX.match(ln)), len(lines))
    lines = lines[:cut]
    label = lambda word, m: f"{word} {m[1].upper() if word == 'Chương' else m[1]}" + (f" - {m[2].strip()}" if m[2].strip() else "")
    heads = [i for i, ln in enumerate(lines) if ARTICLE.match(ln) and not CHAPTER.match(ln) and not SECTION.match(ln)]
    out, chapter, section = [], "", ""
    if heads:
        for i, ln in enumerate(lines):
            if m := CHAPTER.match(ln):
                chapter, section = label("Chương", m), ""
            elif m := SECTION.match(ln):
                section = label("Mục", m)
            elif i in heads:
                m = ARTICLE.match(ln)
                end = next((h for h in heads if h > i), len(lines))
                body, title = lines[i + 1 : end], m[2].strip()
                if not title and body and body[0] and not any(x.match(body[0]) for x in (CLAUSE, POINT, CHAPTER, SECTION)) and len(body[0]) <= 220:
                    title, body = body[0], body[1:]
                out.append((f"Điều {m[1]}", title, chapter, section, "\n".join(body).strip()))
        return out
    blocks = []
    for ln in lines:
        opener = None
        if m := CHAPTER.match(ln):
            chapter, section = label("Chương", m), ""
            opener = chapter
        elif m := SECTION.match(ln):
            opener = section = label("Mục", m)
        elif m := HEADING.match(ln):
            opener = section = m[1].strip() + (f": {m[2].strip()}" if m[2].strip() else "")
        if opener is not None:
            blocks.append([opener, chapter, section, []])
            continue
        if ln and (not blocks or NUMBERED.match(ln) and len(blocks[-1][3]) > 2):
            blocks.append([ln[:220] if NUMBERED.match(ln) else "", chapter, section, []])
        if blocks:
            blocks[-1][3].append(ln)
    for title, chapter, section, body in blocks:
        content = "\n".join(body).strip()
        if content:
            first = body[0]
            out.append((f"Mục {len(out) + 1}", title or (first if len(first) <= 220 else ""), chapter, section, content))
    return out


def plain_clauses(content):
    out, current = [], None
    for ln in content.split("\n"):
        if m := CLAUSE.match(ln):
            current = [m[1], [ln]]
            out.append(current)
        elif current:
            current[1].append(ln)
    return [(n, "\n".join(body).strip()) for n, body in out]


def plain_points(content):
    out, current = [], None
    for ln in re.sub(r"(?<=[;.:!])\s+([a-zđ])\s*\)\s+", r"\n\1) ", content, flags=re.I).split("\n"):
        ln = ln.strip()
        if m := POINT.match(ln):
            current = [m[1].lower(), [ln]]
            out.append(current)
        elif current:
            current[1].append(ln)
    return [(n, "\n".join(body).strip()) for n, body in out]


LINES = ["Chương I. Chung", "CHƯƠNG II", "Mục 1. Đầu", "Mục 2", "Điều 1. Phạm vi", "Điều 2", "Điều 3a:", "1. Khoản một", "2) hai; a) nhỏ; b) to", "Khoản 3. ba", "a) điểm a", "đ. điểm đ", "một dòng", "dòng khác", "", "Nội dung: mở", "Mục tiêu", "Phần", "x" * 230, "12. mười hai"]


def corpus(n=160, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [ln for ln in LINES if not ln.startswith("Điều")] if i % 2 else LINES
        body = [r.choice(lines) for _ in range(r.randrange(0, 25))]
        if r.random() < 0.15:
            body.insert(r.randrange(len(body) + 1), "Phụ lục I")
        out.append((i, r.choice(["\n", "\r\n"]).join(body)))
    return [*out, (1000, None), (1001, ""), (1002, "\n \n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "document_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def found(docs):
    return tree.articles(docs).cache()


def test_articles_equal_plain_parser(found):
    got = {}
    for r in found.orderBy("document_id", "article_ord").collect():
        got.setdefault(r["document_id"], []).append((r["label"], r["title"], r["chapter"], r["section"], r["content"]))
    for i, text in corpus():
        assert got.get(i, []) == plain_articles((text or "").replace("\r\n", "\n")), text


def test_clauses_and_points_equal_plain_parser(found):
    for r in found.collect():
        want = plain_clauses(r["content"])
        assert [(c["number"], c["content"]) for c in r["clauses"]] == want
        assert [[(x["letter"], x["content"]) for x in c["points"]] for c in r["clauses"]] == [plain_points(c) for _, c in want]


def test_chapters(docs, found):
    got = {}
    for r in tree.chapters(docs, found).orderBy("document_id", "sort_order").collect():
        got.setdefault(r["document_id"], []).append((r["chapter_number"], r["title"], r["articles"]))
    for i, text in corpus():
        arts = plain_articles((text or "").replace("\r\n", "\n"))
        lines = [ln.strip() for ln in (text or "").replace("\r\n", "\n").split("\n")]
        lines = lines[: next((k for k, ln in enumerate(lines) if APPENDIX.match(ln)), len(lines))]
        heads = {}
        for ln in lines:
            if m := CHAPTER.match(ln):
                heads[m[1].upper()] = m[2].strip()
        places = lambda n: [k for k, a in enumerate(arts, 1) if re.match(rf"Chương {n}\b", a[2])]
        want = [(n, t, places(n)) for n, t in heads.items()] or ([("", "", list(range(1, len(arts) + 1)))] if arts else [])
        assert got.get(i, []) == want, text


def test_pieces_of_clauses(spark):
    text = "Điều 1. Có khoản\n1. đầu\na) một\nb) hai\nĐiều 9\nĐiều 2. Không khoản\nmở đầu\na) một; b) hai"
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    rows = tree.clause_rows(tree.articles(docs)).orderBy("article_ord", "place").collect()
    assert [(r["article_ord"], r["clause_number"], r["content"]) for r in rows] == [
        (1, "Khoản 1", "1. đầu"), (1, "Khoản 1.2", "a) một"), (1, "Khoản 1.3", "b) hai"), (1, "Điểm a", "a) một"), (1, "Điểm b", "b) hai"),
        (2, "Khoản 1", ""), (3, "Khoản 1", "mở đầu"), (3, "Khoản 1.2", "a) một; b) hai"), (3, "Điểm a", "a) một;"), (3, "Điểm b", "b) hai"),
    ]


def test_registered_for_sql(spark, docs):
    tree.register(spark)
    tree.read_lines(docs).createOrReplaceTempView("tree_lines")
    got = spark.sql("SELECT * FROM parse_tree(TABLE(tree_lines) PARTITION BY document_id ORDER BY line_no)")
    assert sorted(map(str, got.collect())) == sorted(map(str, tree.blocks(docs).collect()))


def test_agrees_with_the_windows_parser(spark):
    """Where both are defined alike - articles with titles in their headers, no chapters - they find the same."""
    text = "Điều 1. Một\n1. a\nnhư sau\n2. b\nĐiều 2. Hai\nnội dung"
    docs = spark.createDataFrame([(1, text), (2, text + "\nĐiều 3. Ba")], "document_id long, text string")
    windows = structure.parsed(docs)["articles"].select("document_id", "article_number", "title", "content").collect()
    assert sorted(map(tuple, windows)) == sorted(map(tuple, tree.articles(docs).select("document_id", "label", "title", "content").collect()))
