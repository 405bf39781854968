"""Tables in buckets: what a change touches, cascades, and files that are read once."""

import os

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import providers
from corpuskiln.plans import ingest
from corpuskiln.plans.engine import Engine
from corpuskiln.sources import files
from corpuskiln.sources.buckets import BUCKET, Buckets

LAW = "THÔNG TƯ\nVề việc giá\nChương I\nMục 1. Đầu\nĐiều 1. Phạm vi\n1. Một;\na) nhỏ\n2. Hai\nĐiều 2. Đối tượng\nNội dung."


def folder(tmp_path, n):
    at = tmp_path / "in"
    at.mkdir(exist_ok=True)
    for i in range(n):
        (at / f"{i}_2024_TT-X.txt").write_text(LAW.replace("giá", f"giá {i}"))
    return at


def written_files(store, name):
    at = store.path(name).removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.startswith("part-")}


def rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


def test_no_table_parses_files_again(spark, tmp_path):
    tables = ingest.corpus_tables(files.files(spark, str(folder(tmp_path, 3))))
    for name, table in tables.items():
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "binaryFile" not in plan, name
        assert "posexplode" not in plan or name == "chunk_vectors", name


def test_files_are_opened_once(spark, tmp_path):
    """An accumulator in the reader counts texts: one per file for all seven tables."""
    seen = spark.sparkContext.accumulator(0)
    raw = files.files(spark, str(folder(tmp_path, 4)))

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    counted = raw.select("path", "content").mapInPandas(count, "path string, content binary")
    for table in ingest.corpus_tables(counted).values():
        table.count()
    assert seen.value == 4


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    at = folder(tmp_path, 12)
    store = Buckets(spark, f"file://{tmp_path}/store", 8)
    ingest.ingested(files.files(spark, str(at)), store)
    assert set(store.names()) == {"documents", "chapters", "sections", "articles", "clauses", "chunk_vectors", "ingest_errors"}
    before = {n: written_files(store, n) for n in store.names()}
    old = {n: store.table(n) for n in store.names()}
    (at / "3_2024_TT-X.txt").write_text(LAW.replace("giá", "giá mới").replace("Điều 2. Đối tượng\nNội dung.", ""))
    changed = files.files(spark, str(at), "3_*.txt")
    doc = changed.select(F.xxhash64("path")).first()[0]
    kept = {n: rows(t.filter(F.col("document_id") != doc)) for n, t in old.items()}
    touched = ingest.ingested(changed, store)
    assert len(touched) == 1
    for name, then in before.items():
        now = written_files(store, name)
        folder_ = f"{BUCKET}={touched[0]}"
        assert {f: t for f, t in now.items() if folder_ not in f} == {f: t for f, t in then.items() if folder_ not in f}, name
        assert rows(store.table(name).filter(F.col("document_id") != doc)) == kept[name], name
    assert store.of("articles", [doc]).count() == 1 and "giá mới" in store.of("documents", [doc]).first().text
    plan = store.of("clauses", [doc])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and BUCKET in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_file_that_breaks_leaves_its_error(spark, tmp_path):
    at = folder(tmp_path, 2)
    store = Buckets(spark, f"file://{tmp_path}/store", 4)
    ingest.ingested(files.files(spark, str(at)), store)
    (at / "1_2024_TT-X.txt").write_bytes(b"\xff\xfe\x00bad")
    ingest.ingested(files.files(spark, str(at), "1_*.txt"), store)
    assert store.table("documents").count() == 1 and store.table("articles").count() == 2 and store.table("ingest_errors").count() == 1


def test_deletes_cascade_and_empty_buckets_go(spark, tmp_path):
    store = Buckets(spark, f"file://{tmp_path}/store", 4)
    ingest.ingested(files.files(spark, str(folder(tmp_path, 5))), store)
    ids = store.table("documents").select("document_id")
    one = [ids.first()[0]]
    store.delete(spark.createDataFrame([(one[0],)], "document_id long"))
    assert all(store.table(n).filter(F.col("document_id") == one[0]).isEmpty() for n in store.names())
    assert store.table("articles").count() == 8
    left = written_files(store, "articles")
    store.delete(store.table("documents"))
    assert left and not written_files(store, "articles") and not written_files(store, "documents")


def test_engine_over_buckets(spark, tmp_path):
    at = folder(tmp_path, 3)
    engine, tables = Engine.ingest(spark, str(at), f"file://{tmp_path}/store")
    assert tables["articles"].count() == 6
    engine, _ = Engine.ingest(spark, str(at), f"file://{tmp_path}/store")  # the same files: nothing twice
    assert engine.tables["articles"].count() == 6
    q = spark.createDataFrame([(1, "đối tượng")], "query_id long, query string")
    assert engine.search(q, 3).count() == 3


def counting(seen):
    class Counting(providers.HashedTokens):  # made here, so that tasks get it by value
        def __call__(self, texts):
            seen.add(len(texts))
            return super().__call__(texts)

    return Counting(8)


def test_vectors_are_made_once_per_text(spark, tmp_path):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b", "c", None, " ", ""])], "chunk_id long, text string")
    seen = spark.sparkContext.accumulator(0)
    model = counting(seen)
    at = f"file://{tmp_path}/vectors"
    got, n = ingest.embedded_once(chunks, at, "m1", model, shards=3)
    assert n == 4 == seen.value  # "a b", "c", blank (null and one space are the same), ""
    want = providers.embedded(chunks, provider=providers.HashedTokens(8))
    assert rows(got.select("chunk_id", "embedding")) == rows(want.select("chunk_id", "embedding"))
    again, n = ingest.embedded_once(chunks, at, "m1", model, shards=3)
    assert n == 0 and again.count() == 6 and seen.value == 4
    more = chunks.unionByName(spark.createDataFrame([(9, "new")], "chunk_id long, text string"))
    assert ingest.embedded_once(more, at, "m1", model)[1] == 1
    assert ingest.embedded_once(chunks, at, "m2", model)[1] == 4  # another model's vectors are its own


def test_embedding_is_taken_up_where_it_stopped(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "chunk_id long, text string")
    at = f"file://{tmp_path}/vectors"

    class Failing(providers.HashedTokens):
        def __call__(self, texts):
            if any(t == "text 7" for t in texts):
                raise RuntimeError("model is gone")
            return super().__call__(texts)

    with pytest.raises(Exception, match="model is gone"):
        ingest.embedded_once(chunks, at, "m", Failing(8), shards=8)
    got, n = ingest.embedded_once(chunks, at, "m", providers.HashedTokens(8), shards=8)
    assert 0 < n < 40 and got.count() == 40
