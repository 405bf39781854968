"""Phrase mining against brute force over whole texts."""

import re
from collections import Counter

from corpuskiln.plans import text_queries


def grams(text):
    w = re.findall("[a-z]+", text.lower())
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_mining_reads_whole_texts(spark, tmp_path):
    docs = [(i, " ".join(f"f{chr(97 + (i * j) % 23)}" for j in range(80)) + (" red green blue" if i % 3 == 0 else " green red blue")) for i in range(30)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic, n, hits = {d: y for d, _, y in labels}, Counter(), Counter()
    for d, t in docs:
        for g in {g for g in grams(t) if len(g) >= 4}:
            n[g] += 1
            hits[g] += toxic[d]
    common = sorted((g for g in n if hits[g]), key=lambda g: (-hits[g], g))[:400]
    base = sum(toxic.values()) / len(docs)
    want = [(g, hits[g], n[g], round(hits[g] / n[g], 6), round(hits[g] / n[g] / base, 6)) for g in common if hits[g] >= 5 and round(hits[g] / n[g], 6) >= 0.7]
    want = sorted(want, key=lambda r: (-r[4], -r[3], -r[1], r[0]))[:12]
    assert [tuple(r) for r in text_queries.rule_mining_lift(spark, str(tmp_path)).collect()] == want
    assert "red green blue" in {r[0] for r in want}
