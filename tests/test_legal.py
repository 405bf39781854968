"""Parsing, structure, layers and answers on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import legal as G
from corpuskiln.functions import rules as U
from corpuskiln.functions import text as X
from corpuskiln.operators import answer as A
from corpuskiln.operators import layers as L
from corpuskiln.operators import lookup as K
from corpuskiln.operators import metrics as M
from corpuskiln.operators import ranks as R
from corpuskiln.operators import search as S
from corpuskiln.operators import store, structure


def one(spark, expr, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("stem, text, want", [
    ("13_2025_TT-BVHTTDL", "", "13/2025/TT-BVHTTDL"), ("13_2025_TT-BVHTTDL_77", "", "13/2025/TT-BVHTTDL"), ("so 13/2025/TT-ABC moi", "", "13/2025/TT-ABC"),
    ("Nghị định 382021NĐ-CP ngày", "", "38/2021/NĐ-CP"), ("542QĐ-UBND", "", "542/QĐ-UBND"), ("tai lieu", "Luật số: 81 / QH15\nx", "81/QH15"), ("tai lieu", "x" * 3001 + " Số: 1/2020/TT-A", "tai lieu"),
])
def test_document_number(spark, stem, text, want):
    assert one(spark, G.document_number(F.col("s"), F.col("t")), s=stem, t=text) == want


@pytest.mark.parametrize("query, want", [
    ("Điều 6 Luật Đầu tư 2025 quy định gì?", ("6", None, None, "Luật Đầu tư", 2025, None)),
    ("điểm b khoản 2 Điều 7a Luật Di sản văn hóa", ("7a", "2", "b", "Luật Di sản văn hóa", None, None)),
    ("Theo luật nào?", (None, None, None, None, None, None)), ("Tóm tắt 49/2025/QĐ-UBND", (None, None, None, None, 2025, "49/2025/QĐ-UBND")),
    ("nội dung 06CT – UBND", (None, None, None, None, None, "06/CT-UBND")), ("năm 1889 Nghị định về phí", (None, None, None, "Nghị định về phí", None, None)),
])
def test_parsed_question(spark, query, want):
    got = one(spark, G.parsed_question(F.col("q")), q=query)
    assert (got.article, got.clause, got.point, got.name, got.year, got.number) == want


def test_kinds_and_small_forms(spark):
    kind = lambda n, s, t: one(spark, G.document_kind(F.col("n"), F.col("s"), F.col("t")), n=n, s=s, t=t)
    assert [kind("5/2020/QH14", "x", ""), kind("x", "1_2020_TT-A", ""), kind("x", "x", "\nTHÔNG - TƯ\n"), kind("x", "x", "theo Nghị quyết"), kind("x", "x", "")] == ["Luật", "Thông tư", "Thông tư", "Nghị quyết", "Văn bản"]
    assert one(spark, G.unglued_numbers(F.col("t")), t="theo 1472024NĐ-CP và 12024QH15") == "theo 147/2024/NĐ-CP và 12024QH15"
    assert one(spark, X.fold("t"), t="Đường Ngô é và ž ő") == "duong ngo e va z o"
    assert one(spark, X.normalised("t"), t="Đ6ều 1\r\nx–y\x07 \\n Chuong II") == "Điều 1\nx-y Chương II"
    assert one(spark, X.without_headers("t"), t="Trang 1/2\nNơi nhận: ai\nnội dung\n____\nđã ký " + "x" * 150) == "nội dung\nđã ký " + "x" * 150
    assert one(spark, X.composed("t"), t="e\u0301") == "é"
    assert one(spark, X.preprocessed("t"), t="đầu\nĐiều 1. A\nx\n\n\n\nĐiều 2. B") == "Điều 1. A\nx\n\nĐiều 2. B"
    assert one(spark, G.subject(F.col("t"), F.lit("Luật")), t="LUẬT\nBÁO CHÍ\nĐiều 1. x") == "BÁO CHÍ"
    assert one(spark, X.placeholder_to_null("t"), t=" N/A ") is None and one(spark, X.placeholder_to_null("t"), t="-") is None


def test_filters_and_scope(spark):
    maps = {"field": {"y_te": ["y tế"], "dat_dai": ["đất đai"]}, "document_type": {"luat": [r"\bluật\b"]}}
    f = U.metadata_filters(F.col("q"), maps, {("document_type", "luat"): ["điều luật"]})
    got = one(spark, f, q="Luật đất đai năm 2024, điều 7A")
    assert tuple(got) == ("dat_dai", "luat", 2024, "7a") and one(spark, f, q="theo điều luật y tế 2021").document_type is None
    assert one(spark, U.query_keywords(F.col("q"), ["của"], ["quản lý"]), q="Quản lý đất của 123 xã quản lý") == ["quản lý", "quản", "đất"]
    ok = U.in_scope(F.col("q"), (r"\bthẩm quyền\b",), ["bóng đá"], ["du lịch"], (r"\bluật\b",))
    assert [one(spark, ok, q=q) for q in ("", "xem bóng đá", "thẩm quyền bóng đá", "đi du lịch", "luật du lịch", "xin chào")] == [False, False, True, False, True, True]


def test_structure_forms(spark):
    text = "Chương II. TỔ CHỨC\nMục 3: Chung\nDieu 6 - Tên\nKhoản 1. một\n1a. hai\n2.Ba; a) x; b) y\na. riêng\ncột   một hai ba bốn năm sáu\nĐiều7\nDài\nĐiều 6. Lại\nMẫu số 1\nĐiều 9. không"
    t = structure.linked(structure.parsed(spark.createDataFrame([(1, text)], "document_id long, text string")))
    articles = sorted((r.article_ord, r.article_number, r.title, r.chapter_number, r.section_number) for r in t["articles"].collect())
    assert articles == [(1, "Điều 6", "Tên", "II", "3"), (2, "Điều 7", "Dài", "II", "3"), (3, "Điều 6", "Lại", "II", "3")]
    clauses = {(r.clause_number, r.kind, r.content) for r in t["clauses"].collect()}
    assert {("Khoản 1", "clause", "một"), ("Khoản 1a", "clause", "hai"), ("Điểm b", "point", "y")} <= clauses and not any("cột" in c for _, _, c in clauses)
    ids = {r.article_ord: r.article_id for r in t["articles"].collect()}
    chunks = t["chunks"].collect()
    assert {r.article_id for r in chunks if r.article_number == "Điều 6"} == {ids[3]}  # the last one of a number
    assert t["sections"].count() == 1 and {r.section_id for r in t["articles"].collect()} == {r.section_id for r in t["sections"].collect()}
    long = spark.createDataFrame([(1, "Điều 1. A\n1. " + "w " * 600)], "document_id long, text string")
    t = structure.linked(structure.parsed(long))
    clause = {r.clause_number: r.clause_id for r in t["clauses"].collect()}
    subs = [r for r in t["chunks"].collect() if r.chunk_type == "token_sub"]
    assert {r.clause_id for r in subs} == {clause["Khoản 1"]} and structure.chunk_metrics(t["chunks"]).first().n_chunks == len(subs) + 2


@pytest.fixture(scope="module")
def law(spark):
    day = lambda d: F.lit(d).cast("date")
    docs = spark.createDataFrame([(1, "45/2024/QH15", "Luật Di sản văn hóa"), (2, "10/2001/QH10", "Luật Di sản văn hóa cũ"), (3, "147/2024/NĐ-CP", "Nghị định sửa đổi về mạng")], "document_id long, doc_number string, title string")
    docs = docs.withColumns({"issued_date": day(None), "effective_date": F.when(F.col("document_id") == 2, day("2002-01-01")).otherwise(day("2025-07-01"))})
    arts = spark.createDataFrame([(11, 1, "Điều 7", "Các hành vi bị nghiêm cấm", "cấm phá"), (12, 1, "Điều 8", "Quyền", "được xem"), (21, 2, "Điều 7", "Khác", "cũ"), (31, 3, "Điều 1", "Sửa", "x"), (32, 3, "Điều 2", "Hiệu lực", "y")], "article_id long, document_id long, article_number string, title string, content string")
    clauses = spark.createDataFrame([(111, 11, "Khoản 1", "a"), (112, 11, "Khoản 2", "b"), (113, 11, "Điểm a", "c")], "clause_id long, article_id long, clause_number string, content string")
    return docs, arts, clauses


def test_lookup(spark, law):
    ask = lambda *qs: spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")
    rows = K.article_lookup(ask("Khoản 2 Điều 7 Luật Di sản văn hóa 2024", "Điều 7 Luật Di sản văn hóa", "khoản 9 điều 7 Luật Di sản văn hóa năm 2001", "Điều 99 Luật Di sản văn hóa"), *law).collect()
    got = sorted((r.query_id, r.article_id, r.clause_id or 0, r.score) for r in rows)
    assert got == [(0, 11, 112, 1.0), (1, 11, 0, 1.0), (1, 11, 111, 0.95), (1, 11, 112, 0.95), (1, 11, 113, 0.95), (1, 21, 0, 1.0), (2, 21, 0, 1.0)]
    found = K.lookup(ask("hành vi nghiêm cấm trong Luật Di sản văn hóa", "Tóm tắt 147/2024/ND-CP", "Hiệu lực của 147/2024/NĐ-CP", "thời tiết"), *law).collect()
    assert sorted({(r.query_id, r.article_id) for r in found}) == [(0, 11), (1, 31), (1, 32), (2, 32)]
    best = K.best_document(ask("tóm tắt 45/2024/QH15", "45/2024/XX-YY", "luật di sản văn hóa cũ", "nghị định về mạng lạ"), law[0]).collect()
    assert sorted((r.query_id, r.document_id, r.tier) for r in best) == [(0, 1, 1), (1, 1, 2), (2, 1, 3)]  # five words of a title count
    pair = K.compared_documents(ask("So sánh luật di sản văn hóa cũ và nghị định 147/2024/NĐ-CP", "xin chào"), law[0]).collect()
    assert sorted((r.query_id, r.side, r.document_id or 0) for r in pair) == [(0, 1, 1), (0, 2, 3), (1, 1, 0)]


def test_layers(spark):
    rows = spark.createDataFrame([("", None, None), ("??? 12", None, None), ("xã này xử lý ra sao", None, None), ("hỏi", 0.9, None), ("một hai ba", None, "s"), ("một hai", None, None), ("một hai ba bốn năm", None, None)], "q string, c double, s string")
    clf = F.when(F.col("c").isNotNull(), L.verdict("a", F.col("c")))
    rule = F.when(F.col("s").isNotNull(), L.verdict("b", 0.77))
    v = L.layered(F.col("q"), clf, None, rule, L.verdict("m", 0.6), ("a",))
    got = [tuple(r.v) for r in rows.select(v.alias("v")).collect()]
    assert got == [("hoi_dap_chung", 0.1, "guard"), ("hoi_dap_chung", 0.15, "guard"), ("m", 0.6, "llm"), ("a", 0.9, "classifier"), ("b", 0.77, "structural"), ("m", 0.5, "llm"), ("m", 0.6, "llm")]
    w = L.layered_by_rules(F.col("q"), clf, rule, L.verdict("p", 0.6))
    assert [r.v.label for r in rows.select(w.alias("v")).collect()] == ["hoi_dap_chung", "p", "admin_scenario", "a", "b", "p", "p"]
    maps = spark.createDataFrame([({"x": 0.6, "y": 0.3},), ({"x": 0.1},), ({"x": 0.4},)], "m map<string,double>")
    assert [r.v and tuple(r.v) for r in maps.select(L.classifier_verdict("m" and F.col("m")).alias("v")).collect()] == [("x", 0.6), ("nan", 0.1), None]
    hits = L.domain_hits(F.col("q"), {"d1": ["đăng ký"], "d2": ["trợ giúp", "xã hội"]})
    assert one(spark, L.domain_filter(hits, also=F.contains("q", F.lit("trợ giúp")), extra="hc"), q="đăng ký trợ giúp xã hội") == ["d2", "d1", "hc"]
    assert one(spark, L.domain_filter(hits), q="không") is None and one(spark, L.document_labels(hits), q="không") == ["chung"]
    assert [one(spark, L.margin_route(F.lit(a), F.lit(b))) for a, b in ((0.5, 0.4), (0.4, 0.5), (0.5, 0.45))] == [True, False, False]
    q = L.routed(spark.createDataFrame([("a",), ("z",)], "label string"), "label", {"a": "r1"})
    out = L.dispatched(q, {"r1": lambda d: d.withColumn("by", F.lit(1)), "general": lambda d: d.withColumn("by", F.lit(0))})
    assert sorted((r.label, r.by) for r in out.collect()) == [("a", 1), ("z", 0)]
    p = spark.createDataFrame([("x", "Phạt tiền", "nội dung"), ("y", "khác", "z")], "k string, title string, content string")
    assert [tuple(r) for r in L.learned_prototypes(p, {"fine": ["phạt"]}).collect()] == [("fine", "Phạt tiền. nội dung")]
    assert one(spark, L.bundle(L.verdict("r", 0.5), L.verdict("m", 0.9), "shadow")).routed == "r" and one(spark, L.bundle(L.verdict("r", 0.5), L.verdict("m", 0.9), "model")).routed == "m"
    assert one(spark, L.merged_utterance(F.lit("old"), L.verdict("new", 0.4))) == "old" and one(spark, L.merged_utterance(F.lit("old"), L.verdict("new", 0.6))) == "new"
    assert {r.label: r.share for r in L.prototype_stats(spark.createDataFrame([("a",), ("a",), ("b",), ("a",)], "label string")).collect()} == {"a": 0.75, "b": 0.25}


def test_answers(spark):
    assert one(spark, A.with_heading(F.col("a")), a="Câu trả lời:\n\nCÂU TRẢ LỜI: x") == "Câu trả lời:\n\nx" and one(spark, A.with_heading(F.col("a")), a="x") == "Câu trả lời:\n\nx"
    body = "y" * 100
    assert tuple(one(spark, A.without_basis(F.col("a")), a=body + "\nCăn cứ pháp lý:\n- z")) == (body, True)
    assert tuple(one(spark, A.without_basis(F.col("a")), a="Căn cứ pháp lý: z\n" + body)) == ("Căn cứ pháp lý: z\n" + body, False)
    assert one(spark, A.with_basis(F.col("a"), F.lit("Căn cứ pháp lý:\n- n")), a=body + "\nCăn cứ pháp lý: cũ").endswith("y\n\nCăn cứ pháp lý:\n- n")
    assert one(spark, A.source_label(F.col("n"), F.col("t")), n="1/2", t="Luật 1/2") == "Luật 1/2" and one(spark, A.source_label(F.col("n"), F.col("t")), n="1/2", t="x" * 95) == "1/2"
    assert one(spark, A.with_numbers(F.col("a"), F.array(F.lit("1/2020/A"), F.lit("1/2020/A"), F.lit(""))), a="x ").endswith("x\n\nVăn bản xác định rõ số hiệu:\n- 1/2020/A")
    assert one(spark, A.with_numbers(F.col("a"), F.array(F.lit("b"))), a="theo 1/2020/NĐ-CP") == "theo 1/2020/NĐ-CP"
    assert one(spark, A.has_article_content(F.col("a")), a="Điều 5: " + "n" * 25) and not one(spark, A.has_article_content(F.col("a")), a="Điều 5: ngắn")
    assert one(spark, A.sanitised(F.col("a")), a='```json\n{"sources": [1], "x": 2} theo 1472024NĐ-CP```') == "theo 147/2024/NĐ-CP"
    assert one(spark, A.submitted_documents(F.col("q")), q="tôi đã nộp: đơn xin, giấy A; B và C") == ["đơn xin", "giấy A", "B", "C"]
    ids = {"don": ["đơn"], "giay": ["giấy tờ"]}
    assert [one(spark, A.document_id(F.col("n"), ids), n=n) for n in ("giay", "Đơn xin", "giấy", "cái gì")] == ["giay", "don", "giay", "cái_gì"]
    assert [one(spark, A.on_topic(F.lit("thư viện công"), F.col("t"), ["công"]), t=t) for t in ([], ["thư"], ["thư", "công"], ["thư", "viện"], ["x", "y", "thư"])] == [True, True, False, True, False]
    assert one(spark, A.draft_basis(F.col("d"), F.array(F.lit("r"))), d="nội dung") == "nội dung\n\nCăn cứ pháp lý:\n    r;"
    assert "Cần bổ sung" in one(spark, A.draft_basis(F.col("d"), F.array().cast("array<string>")), d="Căn cứ pháp lý: bịa đặt\nĐiều 1. x")
    assert one(spark, A.judged(F.col("r")), r='```json\n{"grounded": false}\n```') is False and one(spark, A.judged(F.col("r")), r="hỏng") is True
    p = spark.createDataFrame([(1, 1, "Điều 1", "Thẩm quyền", 0.9, "5/2020/A", "x"), (1, 2, "Điều 2", "Mức phạt", 0.5, "6/2020/B", "y"), (1, 3, None, None, 0.1, None, "z")], "query_id long, rank long, article_number string, article_title string, score double, doc_number string, document_title string")
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id long, query string")
    pick = lambda q: [r.rank for r in A.single_article(p, ask(q)).collect()]
    assert pick("mức phạt bao nhiêu") == [2] and pick("ai có quyền") == [1] and pick("điều 2 nói gì") == [2]
    assert [r.rank for r in A.of_reference(p, ask("theo 6/2020/B")).collect()] == [2] and A.of_reference(p, ask("gì")).count() == 3
    found = spark.createDataFrame([(1, "một hai"), (1, "ba")], "query_id long, text string")
    g = A.grounded(spark.createDataFrame([(1, "một hai"), (2, "x")], "query_id long, answer string"), found).orderBy("query_id").collect()
    assert [(r.similarity, r.grounded) for r in g] == [(1.0, True), (0.0, False)]
    src = spark.createDataFrame([("s" * 9, "Luật", "1/2", None)], "snippet string, document_title string, doc_number string, article_number string").withColumns({"article_title": F.lit(""), "document_id": F.lit(7)})
    legacy = src.select(F.struct("*").alias("source")).select(A.legacy_source().alias("v")).first().v
    assert legacy.metadata == {"law_name": "Luật", "doc_number": "1/2", "document_id": "7"}


def test_stores(spark, tmp_path):
    logs = spark.createDataFrame([], "query string, answer string, created_at timestamp, log_id long")
    new = spark.createDataFrame([("q", "a" * 300)], "query string, answer string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    kept = store.logged(logs, new)
    assert kept.count() == 1 and len(store.recent_logs(kept).first().answer) == 203
    t = store.repaired_numbers(spark.createDataFrame([("45_2024_QH15_583769",), ("45/2024/QH15",), ("x",)], "doc_number string"))
    assert [(r.doc_number, r.repaired) for r in t.collect()] == [("45/2024/QH15", True), ("45/2024/QH15", False), ("x", False)]
    assert "| x | 1 |" in store.report({"t": spark.createDataFrame([("x", 1)], "a string, b long")}, str(tmp_path)) and spark.read.json(f"{tmp_path}/t").count() == 1
    c = spark.createDataFrame([("c1", {"a": "1", "b": "2"}), ("c2", None)], "conversation_id string, context map<string,string>")
    m = store.merged_context(c, spark.createDataFrame([("c1", {"b": "3"})], "conversation_id string, context map<string,string>"))
    assert {r.conversation_id: r.context for r in m.collect()} == {"c1": {"a": "1", "b": "3"}, "c2": {}}
    d = store.with_columns(spark.createDataFrame([(1,)], "a long"), {"a": "long", "law_intents": "array<string>"})
    assert d.first() == (1, None) and store.new_conversations(c.select("conversation_id"), spark.createDataFrame([("t",)], "title string"), F.lit("2024-01-01").cast("timestamp")).count() == 3
    s = spark.range(100)
    assert store.seeded_sample(s, 5, "id").collect() == store.seeded_sample(s.repartition(7), 5, "id").collect()


def test_ranks_and_metrics(spark):
    rows = spark.createDataFrame([(1, d, i) for d in range(3) for i in range(9)] + [(2, 7, i) for i in range(20)], "query_id long, doc long, i long")
    got = R.quota(rows, "doc", [F.col("i")], 10, over="query_id").groupBy("query_id", "doc").count().collect()
    assert sorted((r.query_id, r.doc, r["count"]) for r in got) == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 7, 10)]
    import statistics

    values = [("a", float(v)) for v in (1, 2, 3, 4, 10)] + [("b", float(i * 7919 % 5003) / 7) for i in range(5000)] + [("c", 5.0)] * 400 + [("c", float(i)) for i in range(300)]
    d = spark.createDataFrame(values, "g string, v double").repartition(4)
    for whole in (200_000, 0):
        for r in M.exclusive_quartiles(d, "g", "v", whole, 1000).collect():
            want = statistics.quantiles([v for g, v in values if g == r.g], n=4)
            assert [r.q1, r.q2, r.q3] == [pytest.approx(w, abs=1e-5) for w in want], (whole, r.g)


def test_vector_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    m = rng.standard_normal((300, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(m)], "vec_id long, embedding array<double>, label int").repartition(5)
    q = v.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in S.vector_top_k(q, v, "vec_id", 4).collect()}
    for i in range(10):
        order = sorted(range(300), key=lambda j: (-round(float(m[i] @ m[j]), 6), j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order
    best = {(r.vec_id, r.label): r.sim for r in S.prototype_scores(v.select("vec_id", "embedding"), v.filter("vec_id < 30").select("label", "embedding"), "vec_id").collect()}
    assert len(best) == 900 and abs(best[5, 1] - max(float(m[5] @ m[j]) for j in range(30) if j % 3 == 1)) < 1e-6


def test_segments_and_terms(spark):
    assert one(spark, structure.trimmed("t"), t="Điều 1. A\nx\nChương II\ny") == "Điều 1. A\nx" and one(spark, structure.trimmed("t"), t="a\nb") == "a\nb"
    assert one(spark, structure.segments("t"), t="đầu\n1. một\nthêm\na) điểm\n2. hai") == ["đầu", "1. một\nthêm", "a) điểm", "2. hai"]
    assert one(spark, structure.segments("t", points=False), t="1. một\na) điểm") == ["1. một\na) điểm"]
    assert one(spark, X.legal_keywords("t", ["của"]), t="Điều 5 của Luật Đất") == ["điều", "luật", "đất", "điều 5", "luật đất"]
    assert one(spark, X.like_terms("t", ["về"], ["tiếng ồn"], 2), t="đo về tiếng ồn") == ["tiếng ồn", "tiếng"]
    docs = spark.createDataFrame([(1, "Tiếng ồn", "karaoke gây ồn", "a"), (2, "Khác", "karaokes ồn", "b"), (3, "Khác", "tiếng", "a")], "k long, h string, b string, n string")
    q = spark.createDataFrame([(1, "karaoke ồn"), (2, "")], "query_id long, query string")
    got = lambda **o: [r.k for r in S.full_text(q, docs, "k", "h", "b", 5, **o).orderBy("rank").collect()]
    assert got() == [1] and sorted(got(prefix=True)) == [1, 2] and got(prefix=True, where=F.col("n") == "b") == [2]


def test_engine_tools(spark, tmp_path):
    from corpuskiln.plans.engine import Engine
    from tests.test_engine import LAW

    (tmp_path / "in").mkdir()
    (tmp_path / "in/13_2025_TT-ABC.txt").write_text(LAW)
    (tmp_path / "in/7_2024_QĐ-XYZ.txt").write_text("QUYẾT ĐỊNH\nVề việc giá nước\nĐiều 1. Giá nước\n1. Giá là mười đồng.\nĐiều 2. Thi hành\nTừ nay.")
    engine, tables = Engine.ingest(spark, str(tmp_path / "in"), str(tmp_path / "tables"))
    assert {r.document_type for r in tables["documents"].collect()} == {"Thông tư", "Quyết định"} and "giá nước" in {r.title for r in tables["documents"].collect()}.pop() + "giá nước"
    ask = lambda *qs: spark.createDataFrame(list(enumerate(qs, 1)), "query_id long, query string")
    got = {r.query_id: r for r in engine.copilot(ask("Tóm tắt 13/2025/TT-ABC", "giá nước", "bóng đá"), 3).collect()}
    assert got[1].route == "lookup" and got[2].route == "search" and all(r.answer.startswith("Câu trả lời") for r in got.values())
    scoped = Engine(spark, engine.chunks, tables=engine.tables, rules={"structural": [], "routing": {}, "overrides": [], "scope": {"strong": (), "blocked": ["bóng đá"]}})
    assert {r.query_id: r.route for r in scoped.copilot(ask("giá nước", "bóng đá"), 3).collect()} == {1: "search", 2: "declined"}
    assert "Giá nước" in engine.tool("summarize", ask("tóm tắt 7/2024/QĐ-XYZ")).first().summary
    assert engine.tool("compare", ask("So sánh 13/2025/TT-ABC và 7/2024/QĐ-XYZ")).count() == 2
    assert "Căn cứ pháp lý" in engine.tool("draft", ask("giá nước")).first().draft and engine.tool("classify", ask("x")).count() == 1
    doc = tables["documents"].filter("document_type = 'Quyết định'").first().document_id
    assert engine.document(doc).first().n_articles == 2 and engine.delete(spark.createDataFrame([(doc,)], "document_id long")).documents().count() == 1
    near = engine.search_widened(ask("giá nước"), F.col("document_id") == doc, 5, 4)
    assert near.filter(F.col("document_id") == doc).count() >= 1 and near.count() == 5
    p = spark.createDataFrame([("Cấp phép", ["giấy phép"], 1, ["don", "giay"])], "name string, keywords array<string>, ord long, required_documents array<string>")
    r = Engine.procedures(ask("xin giấy phép, đã nộp: đơn"), p, {"don": ["đơn"]}).first()
    assert r.missing == ["giay"] and not r.complete
