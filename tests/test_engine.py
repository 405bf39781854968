import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuskiln.functions import rules as U
from corpuskiln.functions import text as X
from corpuskiln.operators import chunks as C
from corpuskiln.operators import metrics as M
from corpuskiln.operators import ranks as R
from corpuskiln.operators import search as S
from corpuskiln.operators import store, structure
from corpuskiln.plans.engine import Engine
from corpuskiln.sources import files

LAW = """Số: 13/2025/TT-ABC
ngày 01 tháng 02 năm 2025
Chương I QUY ĐỊNH CHUNG
Mục 1 Phạm vi
Điều 1. Phạm vi điều chỉnh
1. Khoản thứ nhất.
2. Khoản thứ hai: a) điểm một; b) điểm hai.
Điều 2
Đối tượng áp dụng
Nội dung của điều hai.
Chương II TỔ CHỨC
Điều 3. Hiệu lực
a) từ ngày ký;
b) đến hết năm.
Phụ lục
Điều 9. Không tính
"""


def test_structure(spark):
    docs = spark.createDataFrame([(1, LAW), (2, "plain text"), (3, "1. Mở đầu\nmột hai\n2. Kết\nba bốn")], "document_id long, text string")
    t = structure.parsed(docs)
    articles = {(r.document_id, r.article_number): r for r in t["articles"].collect()}
    assert set(articles) == {(1, "Điều 1"), (1, "Điều 2"), (1, "Điều 3"), (3, "Điều 1"), (3, "Điều 2")}
    assert articles[1, "Điều 1"].chapter_number == "I" and articles[1, "Điều 1"].section_number == "1"
    assert articles[1, "Điều 2"].title == "Đối tượng áp dụng" and articles[1, "Điều 2"].content == "Nội dung của điều hai."
    assert articles[1, "Điều 3"].chapter_number == "II" and articles[1, "Điều 3"].section_number is None
    clauses = [(r.article_ord, r.clause_number, r.kind) for r in t["clauses"].orderBy("article_ord", "clause_ord", "clause_number").collect()]
    assert (1, "Khoản 2", "clause") in clauses and (1, "Điểm b", "point") in clauses and (3, "Điểm a", "point") in clauses
    assert [r.document_id for r in t["errors"].collect()] == [2]
    kinds = {(r.document_id, r.chunk_type, r.clause_number) for r in t["chunks"].collect()}
    assert (1, "clause", "Khoản 1") in kinds and (1, "clause", "Điểm a") in kinds  # article 3 has points only
    assert t["chapters"].filter("document_id = 1").count() == 2


def test_windows(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1000))), (2, "a b"), (3, ""), (4, " ".join("x" for _ in range(512)))], "id long, text string")
    rows = {(r.id, r.start): len(r.words) for r in C.token_windows(df).collect()}
    assert rows == {(1, 0): 512, (1, 432): 512, (1, 864): 136, (2, 0): 2, (4, 0): 512}


def passages(spark, rows):
    return spark.createDataFrame([(1, i + 1, d, s) for i, (d, s) in enumerate(rows)], "query_id long, rank long, doc long, score double")


@pytest.mark.parametrize("rows, cap", [([(1, 0.9), (2, 0.89)], 3), ([(1, 0.9), (2, 0.89), (3, 0.88), (4, 0.5), (5, 0.4)], 5), ([(1, 0.9), (2, 0.5)], 1), ([(1, 0.9)], 1)])
def test_dynamic_cap(spark, rows, cap):
    assert R.dynamic_cap(passages(spark, rows), "score", "doc").first()["cap"] == cap


def test_diversify(spark):
    order = lambda rows: [r.doc for r in R.diversified(passages(spark, rows), "doc").orderBy("new_rank").collect()]
    assert order([(1, 0.9), (1, 0.8), (1, 0.7)]) == [1, 1, 1]
    assert order([(1, 0.9), (2, 0.85), (3, 0.8), (1, 0.7), (2, 0.6)]) == [1, 2, 3, 1, 2]
    assert order([(1, 0.9), (None, 0.88), (2, 0.85), (3, 0.8), (1, 0.7)]) == [1, 2, 3, 1, None]


def test_rrf(spark):
    rows = spark.createDataFrame([(1, 7, 1, 0.5), (1, 8, 2, 0.4)], "query_id long, doc long, rank long, score double")
    top = R.rrf([rows, rows], ["doc"]).orderBy("rank").collect()
    assert top[0].doc == 7 and abs(top[0].rrf_score - 2 / 61) < 1e-12


def test_quartiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 10)] + [("b", 5.0)], "k string, v double")
    rows = {r.k: r for r in M.exclusive_quartiles(df, "k", "v").collect()}
    assert (rows["a"].q1, rows["a"].q2, rows["a"].q3) == (1.5, 3.0, 7.0) and rows["b"].q2 == 5.0


def test_rules(spark):
    rules = [U.Rule("lookup", (r"điều \d+",), 20, 0.98), U.Rule("summary", ("tóm tắt", "(?!)", "("), 30, 0.95)]
    df = spark.createDataFrame([("ĐIỀU 6 Luật Đầu tư",), ("Tóm tắt Điều 6",), ("Karaoke gây ồn",), ("",)], "q string")
    got = [r.m for r in df.select(U.first_match(F.col("q"), rules).alias("m")).collect()]
    assert [m and m.label for m in got] == ["lookup", "summary", None, None]


def test_text(spark):
    df = spark.createDataFrame([("Điều 12a. Thể dục", "13_2025_TT-BVHTTDL.docx", "ngày 31 tháng 02 năm 2025"), (None, "x", "ngày 01 tháng 02 năm 2025")], "a string, p string, d string")
    r = df.select(X.fold("a").alias("f"), X.canonical_number("a").alias("n"), files.number_from_name(F.col("p"), F.col("d")).alias("no"), X.spoken_date("d").cast("string").alias("day")).collect()
    assert r[0].f == "dieu 12a. the duc" and r[0].n == "12a" and r[0].no == "13/2025/TT-BVHTTDL" and r[0].day is None
    assert r[1].f is None and r[1].no == "x" and r[1].day == "2025-02-01"


def test_cover_density():
    assert S.cover_rank([], "a x b".split(), ["a", "b"], (1.0, 0.4)) == round(0.4 / 2, 6)
    assert S.cover_rank([], "a x".split(), ["a", "b"], (1.0, 0.4)) == 0.0
    assert S.cover_rank(["a", "b"], ["a"], ["a", "b"], (1.0, 0.4)) > S.cover_rank([], ["a", "b", "a"], ["a", "b"], (1.0, 0.4))


def test_references(spark):
    docs = spark.createDataFrame([(1, "13/2025/TT-ABC"), (2, "13/2025/NĐ-CP"), (3, "7/2020/QH")], "document_id long, doc_number string")
    q = spark.createDataFrame([(1, "13/2025/TT-ABC"), (2, "13/2025"), (3, "13_2025_nd-cp"), (4, "7/qh"), (5, "99/1999")], "query_id long, ref string")
    rows = {}
    for r in S.resolve_references(q, docs).collect():
        rows.setdefault(r.query_id, []).append(r.document_id)
    assert {k: sorted(v) for k, v in rows.items()} == {1: [1], 2: [1, 2], 3: [2], 4: [3]}


def test_store(spark):
    m = spark.createDataFrame([(1, i) for i in range(1, 104)], "conversation_id long, message_id long")
    kept = store.add_messages(m, spark.createDataFrame([(1, 200), (2, 1)], m.schema))
    assert kept.filter("conversation_id = 1").count() == 100 and kept.filter("message_id = 200").count() == 1
    t = store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c")], "k long, v string"), ["k"])
    assert sorted(map(tuple, t.collect())) == [(1, "a"), (2, "c")]
    now = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    schema = "key string, answer string, sources array<struct<document_id:long>>, expires_at timestamp"
    cache = store.cache_put(spark.createDataFrame([], schema), spark.createDataFrame([("Hỏi ", "đáp", [(7,)])], "query string, answer string, sources array<struct<document_id:long>>"), now)
    asked = spark.createDataFrame([("hỏi",)], "query string")
    assert store.cache_get(cache, asked, now).first().answer == "đáp"
    assert store.cache_get(cache, asked, now + F.expr("interval 2 hours")).first().answer is None
    assert store.cache_drop(cache, document_id=7).count() == 0 and store.cache_drop(cache, document_id=8).count() == 1


def docx(path, paragraphs, cells):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    c = "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in cells)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr>{c}</w:tr></w:tbl>{p}</w:body></w:document>')


def test_ingest_and_answer(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    docx(folder / "13_2025_TT-ABC.docx", LAW.strip().split("\n"), ["x", "y"])
    (folder / "bad.docx").write_bytes(b"nope")
    (folder / "old.doc").write_bytes(b"x")
    engine, tables = Engine.ingest(spark, str(folder))
    assert tables["documents"].first().doc_number == "13/2025/TT-ABC"
    assert {r.reason[:10] for r in tables["ingest_errors"].collect()} == {"BadZipFile", "legacy .do"}
    q = spark.createDataFrame([(1, "đối tượng áp dụng"), (2, "hiệu lực từ ngày ký")], "query_id long, query string")
    out = {r.query_id: r for r in engine.answer(q, 3).collect()}
    assert "Đối tượng áp dụng" in out[1].answer and "Điều 2" in out[1].citations and 0 <= out[1].confidence <= 1
    assert "Hiệu lực" in out[2].answer


def test_streams(spark, tmp_path):
    from corpuskiln.streaming import pipelines

    (tmp_path / "in").mkdir()
    docx(tmp_path / "in" / "1_2024_TT-X.docx", LAW.strip().split("\n"), ["x"])
    for _ in range(2):  # the second run finds nothing new
        pipelines.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/articles")).count() == 3
    spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9)], "conversation_id long, message_id long").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("conversation_id long, message_id long").parquet(str(tmp_path / "m"))
    q = pipelines.newest_messages(stream, 3).writeStream.format("memory").queryName("kept").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM kept").collect())) == [(1, 3, 2), (2, 1, 9)]


def test_docx_order():
    buffer = io.BytesIO()
    docx(buffer, ["một", "", "hai"], ["a", "b"])
    assert files.docx_text(buffer.getvalue()) == "một\nhai\na | b"
