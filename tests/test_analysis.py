"""Analysis of questions, reports, conversations."""

import json

from pyspark.sql import functions as F

from corpuskiln.functions import rules
from corpuskiln.operators import search
from corpuskiln.plans.engine import Engine

MAPS = {"field": {"van_hoa": ["lễ hội", "di tích"], "dat_dai": ["đất"]}, "government_level": {"xa": ["cấp xã", "ubnd xã"], "tinh": ["cấp tỉnh"]}}
ORDERS = {"date_desc": ["mới nhất"], "date_asc": ["cũ nhất"]}
CASES = {"subject": {"ho_dan": ["hộ dân"]}, "violation": {"tieng_on": ["ồn"]}, "severity": {"nang": ["nghiêm trọng"]}}
UNKNOWN = {"subject": "không xác định", "violation": "không có", "severity": "chưa xác định"}


def test_analysis(spark):
    rows = ["Văn bản mới nhất về lễ hội cấp xã năm 2024, Điều 5", "Hộ dân gây ồn nghiêm trọng", "rất nghiêm trọng", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, q string")
    a = rules.analysis(F.col("q"), MAPS, ORDERS, CASES, UNKNOWN, ("subject", "violation"), ["rất"], ["lễ hội"])
    got = [r["a"].asDict(recursive=True) for r in df.withColumn("a", a).orderBy("i").collect()]
    assert got[0]["filters"] == {"field": "van_hoa", "government_level": "xa", "year": 2024, "article": "5"} and got[0]["sort"] == "date_desc"
    assert got[0]["keywords"][0] == "lễ hội" and got[0]["situation"] is None
    assert got[1]["situation"] == {"subject": "ho_dan", "violation": "tieng_on", "severity": "nang"} and got[1]["sort"] == "relevance"
    assert got[2]["situation"] is None and got[2]["keywords"] == ["nghiêm", "trọng"]
    assert got[3]["situation"] is None and got[3]["keywords"] == [] and got[3]["filters"]["year"] is None


def test_prototypes_may_be_many(spark):
    vec = lambda i, n: [float((i * k) % 7 - 3) for k in range(1, n + 1)]
    items = spark.createDataFrame([(i, vec(i, 4)) for i in range(50)], "vec_id long, embedding array<float>")
    protos = spark.createDataFrame([(i % 3, vec(i + 5, 4)) for i in range(9000)], "label int, embedding array<float>").repartition(4)
    want = {}
    held = {(i % 3, tuple(vec(i + 5, 4))) for i in range(9000)}
    for i in range(50):
        for label, p in held:
            s = sum(a * b for a, b in zip(vec(i, 4), p))
            want[i, label] = max(want.get((i, label), s), s)
    assert {(r["vec_id"], r["label"]): r["sim"] for r in search.prototype_scores(items, protos, "vec_id").collect()} == want


def test_report_and_conversations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/13_2025_TT-ABC.txt").write_text("THÔNG TƯ\nĐiều 1. Phạm vi\nMột.\nĐiều 2. Hai\nHai.")
    engine, _ = Engine.ingest(spark, str(tmp_path / "in"), f"file://{tmp_path}/store")
    text = engine.report(f"file://{tmp_path}/report")
    assert "## kinds" in text and "| Thông tư | 1 |" in text and "## documents" in text
    lines = [json.loads(ln) for f in (tmp_path / "report/documents").glob("part-*") for ln in f.read_text().splitlines()]
    assert lines[0]["n_articles"] == 2 and lines[0]["n_chunks"] >= 2
    convs = spark.createDataFrame([("c", ["a"])], "conversation_id string, document_history array<string>")
    msgs = spark.createDataFrame([("c", 1, "user", "x")], "conversation_id string, message_id long, role string, text string")
    said = spark.createDataFrame([("c", 2, "user", "xem 12/2020/NĐ-CP"), ("c", 3, "assistant", "y")], "conversation_id string, message_id long, role string, text string")
    convs, msgs = engine.conversation(convs, msgs, said, 2)
    assert convs.first()["document_history"] == ["a", "12/2020/NĐ-CP"] and sorted(r["message_id"] for r in msgs.collect()) == [2, 3]
