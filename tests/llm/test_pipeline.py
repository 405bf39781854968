"""The pipeline against plain versions of its stages, each judged on its own input."""

import random

import pytest

import corpus_pipeline
from corpuskiln.llm import sharding, tiling
from tests.llm import plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, say(30)) for i in range(4)]
    docs, labels = [], []
    for i in range(400):
        text, toxic = say(r.randint(20, 80)), int(i % 5 == 0)
        if toxic:
            text = text.replace(" ", " lout ", 1)
        docs.append((i, text, "en", f"s{r.randint(0, 3)}", len(text)))
        labels.append((i, 1, toxic))
    for i in range(400, 430):  # copies, near copies, leaks
        source = docs[(i - 400) * 5 + 1][1].split()
        if i % 3 == 1:
            source.append("tail")
        text = " ".join(source) if i % 3 else "x " + bench[i % 4][1] + " y"
        docs.append((i, text, "en", "s0", len(text)))
    docs += [(500, None, None, None, None), (501, "", "en", "s1", 0), (3, docs[3][1], "en", docs[3][3], docs[3][4]), (None, "no id here " + say(9), "en", "s2", 5)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)

    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns
    assert rows(clean) == [x for x in rows(docs) if "lout" not in (x[1] or "").split()]

    single = stages["ngram_jaccard"](spark, clean, folder).cache()
    want = {(d, t) for (d, t), (_, n, c) in zip(rows(clean), plain.components(rows(clean))) if not n or d == c}
    assert single.columns == docs.columns and rows(single) == sorted(want, key=str)

    safe = stages["decontamination"](spark, single, folder).cache()
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean_by_tiling = [d for d, leak in zip(rows(single), plain.leaks([x[:2] for x in rows(single)], list(enumerate(bench)))) if not leak[4]]
    assert rows(safe) == clean_by_tiling and safe.columns == docs.columns and len(clean_by_tiling) < len(rows(single))

    mixed = stages["mixing"](spark, safe, folder).cache()
    assert mixed.columns == docs.columns
    size, taken = {}, {}
    for df, out in ((safe, size), (mixed, taken)):
        for r in df.collect():
            out[r.source] = out.get(r.source, 0) + len(plain.words(r.text))
    for source, aim in plain.targets(size).items():
        assert abs(taken.get(source, 0) - aim) <= 100
    assert set(rows(mixed)) <= set(rows(safe)) and max(rows(mixed).count(x) for x in set(rows(mixed))) <= 2

    out = stages["sharding"](spark, mixed, folder)
    assert rows(out) == rows(mixed) and set(sharding.ADDED) < set(out.columns)
    assert out.filter(f"shard_bytes > {sharding.LIMIT} AND NOT oversized").count() == 0
    assert rows(corpus_pipeline.run(spark, folder)) == rows(out)


def test_columns_named_like_results(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", tiling.F.lit("mine")).withColumn("predicted", tiling.F.lit(1))
    out = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, folder)
    assert out.columns == docs.columns and {r.score for r in out.select("score").distinct().collect()} == {"mine"}


NAMES = "key key_ _key score predicted _hits hits who times block bits at leaf_depth leaf_docs leaf_bytes _bits _depth _d _n _b _prefix _times _nth _copy comp cls row n h shard".split()


def test_columns_named_like_inner_ones(spark, folder):
    """No stage crashes on, loses or changes a column that is named like one of its own."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    docs = docs.select("*", *[tiling.F.concat(tiling.F.lit(n), tiling.F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in NAMES), name


def test_empty_documents(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group(spark):
    r = random.Random(5)
    say = lambda n: " ".join(f"k{r.randrange(10**6)}" for _ in range(n))
    a, b, c = say(40), say(40), say(40)
    rows = [(None, None)] * 3 + [(7, " \n")] * 2 + [(8, "")]  # without words: all stay
    rows += [(None, a), (None, a + " more"), (None, a)]  # ids all null: one stays
    rows += [(1, b), (1, b + " more"), (2, b)]  # the least id twice: one stays
    rows += [(1, c), (3, c + " more"), (3, c)]  # another component of the same least id
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.text) for x in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, "").collect()]
    assert sorted(x for x in got if not (x[1] or "").strip() and x[0] is not None) == [(7, " \n"), (7, " \n"), (8, "")]
    assert got.count((None, None)) == 3 and len(got) == 9
    assert sum((t or "").startswith(a) and d is None for d, t in got) == 1
    assert sum((t or "").startswith(b) and d == 1 for d, t in got) == 1 and (1, c) in got
