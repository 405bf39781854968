"""Personal data: strict spans against plain regular expressions, places, and what the model adds."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import pii as P

_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, match):
    ds = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(ds))]
        return 16 <= len(ds) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(ds) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in _BASE for m in re.finditer(p, text or "") if passes(k, m.group())]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def card(rnd, grouped=False):
    ds = [rnd.randrange(10) for _ in range(15)]
    for last in range(10):
        n = "".join(map(str, [*ds, last]))
        if passes("card", n):
            return " ".join(n[i : i + 4] for i in range(0, 16, 4)) if grouped else n


def noisy(n, seed=5):
    rnd = random.Random(seed)
    parts = ["a@b.c", "_d@e.f", "x@y", "@", "é@mail.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.02.3.255", "+1 (743) 555-3824", "+12", "+1234567", "00", "-", " ", "日本", "😀", ".", "word", "4", "1234 5678", "a.b.c@d-e.co.uk.", "--", "(", ")", "\n"]
    out = []
    for _ in range(n):
        text = "".join(rnd.choice([*parts, card(rnd), card(rnd, True)]) + rnd.choice(["", "", " "]) for _ in range(rnd.randrange(1, 14)))
        out.append(text)
    return out


def test_strict_spans_equal_plain_patterns(spark):
    texts = [None, "", *noisy(400), "a" * 50_000, "9" * 50_000 + "@", "a.b@" + "c." * 20_000 + "d", "+1" + " " * 50_000, "1 " * 30_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)
    got = {r["doc_id"]: r["b"] for r in P.scanned(docs).select("doc_id", P.told("base").alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == joined(base(t)), t


def test_places_of_very_many_matches(spark):
    text = "é 1.2.3.4 x@y.zz\n" * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert P.scanned(docs).select(P.told("base")).first()[0] == joined(base(text))


def corpus(seed=11, n=300):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    out = []
    for i in range(n):
        phone = f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        given = rnd.choice([phone, card(rnd), f"{rnd.randrange(255)}.{rnd.randrange(255)}.1.9", f"{word()}@{word()}.com", f"token={hashlib.md5(str(i).encode()).hexdigest()}", f"v{i}.{i % 9}.2", f"no {rnd.randrange(10**15, 10**16)}"])
        out.append((i, f"{word()} {word()} {given} {word()}."))
    run = f"{word()} +1 (269) 555-3296 {card(rnd)} {word()}."
    return [*out, (1000, run), (1001, run), (1002, None), (None, "clean words only")]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["b"], r["s"]) for r in P.find(docs).select("doc_id", P.told("base").alias("b"), P.told("spans").alias("s")).collect()}


def test_model_adds_what_the_strict_rules_drop(found):
    text = dict(corpus())[1000]
    spans = [x.split(":") for x in found[1000][1].split(",")]
    assert found[1000][0] == "" and found[1001] == found[1000]
    assert [(k, text[int(s) : int(e)]) for k, s, e in spans] == [("card", text.split()[4]), ("phone", "+1 (269) 555-3296")]


def test_base_stays_and_clean_texts_stay_clean(found):
    for i, text in corpus():
        strict, every = found[i]
        assert strict == joined(base(text))
        assert set(strict.split(",")) - {""} <= set(every.split(","))
        if i != 1000 and i != 1001:
            assert every == strict, text


def test_thresholds_are_monotone_shares():
    assert P.threshold([], 0.9) is None
    assert P.threshold([(0, 5, 10), (4, 50, 50)], 0.9) == 4
    assert P.threshold([(-2, 100, 100), (3, 0, 100), (5, 100, 100)], 0.9) == 5  # the lower bins are pooled with the poor one
    assert P.threshold([(1, 3, 3)], 0.9) is None  # too few to be sure


def test_trees_split_where_gradients_differ():
    feature, most, left, right = P._best([("digits", 3, -5.0, 5.0), ("digits", 9, 5.0, 5.0), ("groups", 1, 0.0, 10.0)])
    assert (feature, most) == ("digits", 3) and left < 0 < right
    assert P._best([("groups", 1, 2.0, 4.0)]) is None


def test_empty_table(spark):
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_luhn(spark):
    rnd = random.Random(2)
    numbers = [str(rnd.randrange(10**15, 10**19)) for _ in range(200)] + [card(rnd) for _ in range(20)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", P.luhn(F.col("n")).alias("ok")).collect()
    assert all(r["ok"] == passes("card", r["n"]) for r in rows)
