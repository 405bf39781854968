"""Keys of any length, and work that is done once for each wording rather than for each question."""

from pyspark.sql import functions as F

from corpuskiln.functions import legal as G
from corpuskiln.operators import lookup, search, textindex, vectorindex
from corpuskiln.operators.vectorindex import CellIndex
from corpuskiln.plans import lookup_queries


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_numbers_and_years_of_questions(spark):
    q = asks(spark, "Tóm tắt 12345NĐ – CP năm 2001", "Tóm tắt 1995NĐ – CP năm 2001", "Tóm tắt 19951NĐ – CP năm 2001", "Tóm tắt 12345/2001/NĐ-CP", "Xem 12345/NĐ-CP", "Luật cũ năm 2001")
    rows = q.select("query_id", G.question_number(F.col("query")).alias("n"), G.question_year(F.col("query")).alias("y")).orderBy("query_id").collect()
    assert [r["n"] for r in rows] == ["12345/NĐ-CP", "1995/NĐ-CP", "19951/NĐ-CP", "12345/2001/NĐ-CP", "12345/NĐ-CP", None]
    assert [r["y"] for r in rows] == [None, None, None, None, None, 2001]


def test_numbers_of_written_documents(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (5, 101, 1001, 12345, 100001)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = {r["k"]: r for r in lookup_queries.document_metadata(spark, str(tmp_path)).collect()}
    assert {k: r["number"] for k, r in rows.items()} == {5: "15/2021/NĐ-CP", 101: "101/2021/NĐ-CP", 1001: "1001/2021/NĐ-CP", 12345: "12345/2021/NĐ-CP", 100001: "100001/2021/NĐ-CP"}
    assert all(r["numbers"] == f"{k}/2025/NĐ-CP,5/2020/TT-BTC" for k, r in rows.items())


def test_closest_text_compares_a_wording_once(spark, monkeypatch):
    q = spark.createDataFrame([(i, i % 2, "red") for i in range(40)], "query_id long, m int, asked string")
    texts = spark.createDataFrame([(i, f"{'red ' * (i % 3)}x{i}", i % 2) for i in range(9)], "part long, held string, m int")
    seen, plain = [], search.closest
    monkeypatch.setattr(search, "closest", lambda found, *more: seen.append(found.count()) or plain(found, *more))
    got = sorted(map(tuple, search.closest_among(q, texts, "m", "asked", "held", "part").collect()))
    want = sorted(map(tuple, plain(q.join(texts, "m"), "asked", "held", "part").collect()))
    assert got == want and len(got) == 40 and seen == [9]


def test_lookups_look_for_a_wording_once(spark, monkeypatch):
    documents = spark.createDataFrame([(i, f"{i}/2020/NĐ-CP", "Luật " + ("Nhà ở" if i % 2 else "Đất đai"), None, None) for i in range(30)], "document_id long, doc_number string, title string, issued_date date, effective_date date")
    q = asks(spark, *["Điều 5 Luật Nhà ở năm 2020 là gì"] * 40)
    seen, plain = [], lookup.meeting
    monkeypatch.setattr(lookup, "meeting", lambda asked, *more, **how: seen.append(asked.count()) or plain(asked, *more, **how))
    named = lookup.documents_named(lookup.parsed(q), documents).collect()
    assert sorted((r["query_id"], r["document_id"], r["rank"]) for r in named) == sorted((i, 29 - 2 * r, r + 1) for i in range(40) for r in range(10))
    best = lookup.best_document(asks(spark, *["luật nhà ở"] * 40, *["Nội dung 7/2020/NĐ-CP"] * 5), documents).collect()
    assert {r["query_id"]: (r["document_id"], r["tier"]) for r in best} == {i: (1, 3) if i < 40 else (7, 1) for i in range(45)}
    assert max(seen) <= 3  # words of a name


def test_runs_of_many_lengths_find_every_text(spark):
    texts = ["", "x", "luật nhà ở", "12345/2001/nd-cp", "112345/2001/nd-cp", "một tên rất dài của một văn bản quy phạm pháp luật nào đó"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, t string")
    terms = sorted({t[a:b] for t in texts for a in range(0, len(t), 3) for b in range(a + 1, len(t) + 1, 4)} | {"12345/2001/nd-cp"})
    met = lookup.meeting(spark.createDataFrame(list(enumerate(terms)), "query_id long, term string"), docs, "document_id", "t").collect()
    met = {(r["query_id"], r["document_id"]) for r in met}
    assert {(i, d) for i, term in enumerate(terms) for d, t in enumerate(texts) if term in t} <= met
    assert [d for q, d in sorted(met) if terms[q] == "12345/2001/nd-cp"] == [3, 4]


def test_exact_vectors_meet_once_and_first_centres_are_those_of_least_hash(spark):
    rows = [(i, [float((i * 7) % 11), float((i * 5) % 13), 1.0]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = CellIndex.build(vectors, "vec_id", cells=6, k=3)
    asked = vectors.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    found = index.search(asked, 5, probes=6)
    assert "probed" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.vector_top_k(asked, vectors, "vec_id", 5).collect()))
    sample = vectors.select(F.col("embedding").alias("v"), "vec_id")
    order = [r["v"] for r in sample.orderBy(F.xxhash64(F.lit(13), F.col("vec_id")), "vec_id").collect()]
    assert vectorindex._first(sample, "vec_id", 6) == order[:6] and vectorindex._first(sample, "vec_id", 400) == order


def test_metadata_is_searched_once_for_each_wording(spark, monkeypatch):
    documents = spark.createDataFrame([(i, "Luật " + ("Nhà ở" if i % 2 else "Đất đai")) for i in range(30)], "document_id long, title string")
    chunks = [(10 * i + k, i, f"khoản {k} mục {i % 4}") for i in range(30) for k in range(3)]
    asked = [(i, "nhà", ["Mục 1", "khoản 9"]) for i in range(20)] + [(i, None, ["khoản 2", "mục 3"]) for i in range(20, 40)] + [(40, "đất", []), (41, "", ["mục 0"]), (42, None, []), (43, "luật", ["nowhere"]), (44, None, ["", "x"])]
    want = []
    for q, field, words in asked:
        words = [] if "" in words else [w.lower() for w in words]
        ids = sorted(c for c, d, t in chunks if (not field or field in ("luật " + ("nhà ở" if d % 2 else "đất đai"))) and (not words or any(w in t for w in words)))
        want += [(q, c, r) for r, c in enumerate(ids[:4], 1)]
    seen, plain = [], lookup.holders
    monkeypatch.setattr(lookup, "holders", lambda terms, *more: seen.append(terms.count()) or plain(terms, *more))
    q = spark.createDataFrame(asked, "query_id long, field string, keywords array<string>")
    found = lookup.metadata_search(q, documents, spark.createDataFrame(chunks, "chunk_id long, document_id long, text string"), 4)
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()) == sorted(want)
    assert seen == [3, 3]  # fields; keywords of questions without one


def test_compared_numbers_are_looked_for_in_one_turn(spark, monkeypatch):
    documents = spark.createDataFrame([(i, f"{i}/{2000 + i % 3}/NĐ-CP", f"Nghị định {i}") for i in range(1, 130)], "document_id long, doc_number string, title string")
    q = asks(spark, *[f"So sánh nghị định {i}/{2000 + i % 3}/NĐ-CP với nghị định {i}/{2000 + i % 3}/QĐ-XX" for i in range(1, 130)])
    plans, plain = [], textindex.written
    monkeypatch.setattr(textindex, "written", lambda df, *more, **how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *more, **how))
    found = lookup.compared_documents(q, documents).collect()
    want = {i: min(j for j in range(1, 130) if f"{i}/{2000 + i % 3}/NĐ-CP" in f"{j}/{2000 + j % 3}/NĐ-CP") for i in range(1, 130)}
    assert {(r["query_id"] + 1, r["side"]): r["document_id"] for r in found} == {(i, s): want[i] if s == 1 else i for i in want for s in (1, 2)}
    assert not any("Join" in p for p in plans if "document_id" in p)  # texts meet terms in the pass over them, not as rows of runs
