"""One path for all questions: lookup, full text, vectors, amendments."""

from pyspark.sql import functions as F

from corpuskiln.operators import providers
from corpuskiln.operators.vectorindex import CellIndex
from corpuskiln.plans.engine import Engine

LAWS = {
    "13_2025_TT-ABC.txt": "THÔNG TƯ\nVề việc quản lý lễ hội\nĐiều 1. Phạm vi\n1. Lễ hội truyền thống.\n2. Lễ hội mới.\nĐiều 2. Hành vi bị cấm\nCấm đốt pháo ở lễ hội.",
    "7_2024_QĐ-XYZ.txt": "QUYẾT ĐỊNH\nVề việc giá nước sạch\nĐiều 1. Giá nước\n1. Giá là mười đồng.\nĐiều 2. Thi hành\nTừ nay.",
    "8_2024_QĐ-XYZ.txt": "QUYẾT ĐỊNH\nVề việc sửa đổi, bổ sung quy định về chợ đêm\nĐiều 1. Giờ mở\nChợ đêm mở lúc tối.\nĐiều 2. Phí\nPhí là hai đồng.\nĐiều 3. Hiệu lực\nTừ nay.",
}


def test_every_question_goes_its_way(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in LAWS.items():
        (tmp_path / "in" / name).write_text(text)
    engine, tables = Engine.ingest(spark, str(tmp_path / "in"), f"file://{tmp_path}/store")
    ask = [(1, "Nội dung 13/2025/TT-ABC"), (2, "giá nước sạch bao nhiêu đồng"), (3, "chợ đêm mở lúc nào"), (4, "xyzzy")]
    q = spark.createDataFrame(ask, "query_id long, query string")
    rows = engine.retrieve(q, 3).select("query_id", "way", "document_title", "article_number", "text", "rank").collect()
    of = lambda i: [r for r in rows if r["query_id"] == i]
    assert {r["way"] for r in of(1)} == {"lookup"} and {r["way"] for r in of(2)} == {"search"}
    assert "mười đồng" in " ".join(r["text"] for r in of(2))
    whole = tables["chunk_vectors"].filter(F.col("document_title").contains("sửa đổi")).count()
    amended = [r for r in of(3) if "sửa đổi" in r["document_title"]]
    assert len(amended) == whole and [r["rank"] for r in sorted(amended, key=lambda r: r["rank"])] == list(range(1, whole + 1))
    out = {r["query_id"]: r for r in engine.answer(q, 3).collect()}
    assert "13/2025/TT-ABC" in out[1]["citations"] and "mười đồng" in out[2]["answer"] and len(out) == 4


def test_full_text_comes_before_parts_of_words(spark):
    chunks = [(1, 1, "5/2020/X", "Luật nước", "1", "giá nước sạch"), (2, 1, "5/2020/X", "Luật nước", "2", "nước ngầm"), (3, 2, "6/2020/X", "Luật đất", "1", "giá đất"), (4, 2, "6/2020/X", "Luật đất", "2", None)]
    table = spark.createDataFrame(chunks, "chunk_id long, document_id long, doc_number string, document_title string, article_number string, text string")
    table = providers.embedded(table).cache()
    engine = Engine(spark, table)
    q = spark.createDataFrame([(1, "giá nước"), (2, "ngầm lạ"), (3, "đất")], "query_id long, query string")
    got = {(r["query_id"], r["chunk_id"]) for r in engine.worded(q, table, 9, False).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (3, 4)}  # the title holds the word of chunk 4; question 2 has no full hit
    some = table.filter("document_id = 1")
    assert {(r["query_id"], r["chunk_id"]) for r in engine.worded(q, some, 9, True).collect()} == {(1, 1), (2, 2)}
    through = Engine(spark, table, cells=CellIndex.build(table, "chunk_id", cells=2))
    same = lambda e: sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in e.search(q, 4).collect())
    assert same(through) == same(engine)
