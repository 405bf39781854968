"""Counts of n-grams against brute force over whole labelled documents."""

import re
from collections import Counter

from corpuskiln.plans import text_queries


def test_ngrams_of_labelled_documents(spark, tmp_path):
    docs = [(1, "One two three, two three " + "x " * 100), (2, "only ONE here"), (3, None), (4, "not labelled"), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 2, 3, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = Counter()
    for i, text in docs:
        w = re.findall("[a-z]+", (text or "").lower()) if i != 4 else []
        want.update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert {r.phrase: r.n for r in text_queries.ngram_counts(spark, str(tmp_path)).collect()} == want
