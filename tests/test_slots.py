"""Model slots, reply parser, features, unsupported lines, pages, mining by levels."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import legal
from corpuskiln.functions import text as X
from corpuskiln.operators import metrics, providers
from corpuskiln.operators.paging import Pages


def test_a_model_is_loaded_once_and_failures_are_rows(spark):
    loads, batches = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        weights = np.array([1.0, 0.5])

        def model(queries, texts):
            batches.add(1)
            sizes = [len(q or "") + len(t or "") for q, t in zip(queries, texts)]
            assert sizes == sorted(sizes)  # rows come by length
            if any(t == "bad" for t in texts):
                raise ValueError("no such text")
            return [float(weights @ [len(q), len(t or "")]) for q, t in zip(queries, texts)]

        return model

    rows = [(i, "q" * (i % 7), "bad" if i % 50 == 3 else None if i % 50 == 4 else "t" * (i % 11)) for i in range(400)]
    pairs = spark.createDataFrame(rows, "id long, query string, text string").coalesce(1)
    got = {r["id"]: r for r in providers.reranked_by(pairs, load).collect()}
    assert loads.value == 1 and batches.value < 400
    for i, q, t in rows:
        want = (0.0, "ValueError: no such text") if t == "bad" else (len(q) + 0.5 * len(t or ""), None)
        assert (got[i]["rerank_score"], got[i]["rerank_score_error"]) == want


def test_a_numpy_classifier_in_the_slot(spark):
    def load():
        names, centres = ["short", "long"], np.array([2.0, 20.0])

        def model(queries):
            off = np.abs(np.array([[len(q)] for q in queries]) - centres)
            return [{"label": names[i], "confidence": float(1 / (1 + d))} for i, d in zip(off.argmin(1), off.min(1))]

        return model

    q = spark.createDataFrame([(1, "ab"), (2, "x" * 20), (3, "y" * 10), (4, None)], "query_id long, query string")
    got = {r["query_id"]: r for r in providers.classified_by(q, load).collect()}
    assert (got[1]["label"], got[1]["confidence"]) == ("short", 1.0) and got[2]["label"] == "long"
    assert got[3]["label"] is None and got[3]["confidence"] == pytest.approx(1 / 9)
    assert got[4]["label"] is None and got[4]["error"].startswith("TypeError")


def test_replies(spark):
    valid, aliases = ("legal_lookup", "procedure", "summarization"), {"article_query": "legal_lookup"}
    rows = [("REASON: x\nINTENT: procedure", "procedure", 0.85), ("intent:  Article_Query", "legal_lookup", 0.85), ("INTENT: nan", "nan", 0.85), ("INTENT: other, maybe summarization", "summarization", 0.72), ("it is a legal_lookup or procedure", "legal_lookup", 0.72), ("no idea", None, 0.0), ("", None, 0.0), (None, None, 0.0)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, reply string").withColumn("x", providers.reply_intent(F.col("reply"), valid, aliases))
    assert [(r["x"]["intent"], r["x"]["confidence"]) for r in df.orderBy("i").collect()] == [r[1:] for r in rows]


def test_query_features(spark):
    rows = ["Điều 5 khoản 2 Nghị định 100/2019/NĐ-CP quy định mức phạt bao nhiêu", "So sánh hai luật", "thủ tục đăng ký " + "rất " * 30, "Liệt kê tất cả", "khái niệm di sản", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, q string").withColumn("f", legal.query_features(F.col("q")))
    got = [r["f"].asDict() for r in df.orderBy("i").collect()]
    on = [{k for k, v in f.items() if v is True} for f in got]
    assert on[0] == {"has_article_ref", "has_clause_ref", "has_doc_number", "asks_fine_amount"}
    assert on[1] == {"needs_comparison", "is_short_query"} and on[3] == {"needs_broad_coverage", "is_short_query"}
    assert {"is_procedure_like", "is_long_query"} <= on[2] and "needs_explanation" in on[4] and on[5] == on[6] == {"is_short_query"}
    assert len(got[0]) == 11 and got[1]["query_length"] == 16 and got[6]["query_length"] == 0


@pytest.mark.parametrize("answer, context, want", [
    ("Theo 12/2020/NĐ-CP.\nTheo 99/2021/TT-X.\nHết", "căn cứ 12_2020_ND-CP", "Theo 12/2020/NĐ-CP.\nHết"),
    ("Theo 99/2021/TT-X.", "không có số nào", "Theo 99/2021/TT-X."),
    ("Theo 99/2021/TT-X.", "12/2020/NĐ-CP", None),
    ("a\n\n\n\nb", "12/2020/NĐ-CP", "a\n\n\n\nb"),
    ("a\n\n99/2021/TT-X\n\nb\n", "12/2020/NĐ-CP", "a\n\nb"),
    (None, "12/2020/NĐ-CP", None), ("12/2020/NĐ-CP", None, "12/2020/NĐ-CP"),
])
def test_lines_that_cite_what_the_context_does_not(spark, answer, context, want):
    df = spark.createDataFrame([(answer, context)], "a string, c string")
    assert df.select(X.supported_lines("a", "c")).first()[0] == want


def test_pages(spark):
    rows = [(i, (i * 7919) % 100) for i in range(1, 254)]
    table = spark.createDataFrame(rows, "id long, n long").repartition(5)
    pages = Pages.build(table, "id", 10, [F.col("n").desc()], folder=4)
    want = [i for i, n in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for n in (0, 3, 17, 25):
        assert [r["id"] for r in pages.page(n).collect()] == want[10 * n : 10 * n + 10]
    assert pages.total == 253 and pages.page(26).count() == 0
    assert [r["id"] for r in pages.after(want[57], 6).collect()] == want[58:64] and pages.after(-1, 5).count() == 0
    plan = pages.page(17)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_folder" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert Pages.build(table.limit(0), "id").page(0).count() == 0


def test_sieve_holds_every_phrase(spark):
    names = [f"w{i} é" for i in range(500)]
    bits = metrics.sieve(spark.createDataFrame([(n,) for n in names], "phrase string"), 1 << 16)
    assert all(bits[metrics._slot(n, 1 << 16)] for n in names) and 400 < bits.sum() <= 500


def test_mining_by_levels_equals_counting_all(spark):
    r = random.Random(2)
    docs = [([r.choice(["aa", "bb", "cc", "dd", "ee", f"rare{i}"]) for _ in range(r.randrange(0, 14))], r.randrange(2)) for i in range(150)]
    frame = spark.createDataFrame([*docs, (None, 1)], "ws array<string>, y int")
    n, hits = Counter(), Counter()
    for ws, y in docs:
        for g in {" ".join(ws[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(ws) - k + 1)}:
            n[g] += 1
            hits[g] += y
    base = (sum(y for _, y in docs) + 1) / 151
    common = sorted((g for g in n if hits[g] and len(g) >= 4), key=lambda g: (-hits[g], g))[:60]
    want = [(g, hits[g], n[g], round(hits[g] / n[g], 6), round(hits[g] / n[g] / base, 6)) for g in common if hits[g] >= 3 and hits[g] / n[g] >= 0.5]
    want = sorted(want, key=lambda x: (-x[4], -x[3], -x[1], x[0]))[:20]
    got = metrics.mined_phrases(frame, "ws", F.col("y"), 4, 3, 0.5, 60, 20)
    assert [tuple(x) for x in got.collect()] == want and len(want) > 10
