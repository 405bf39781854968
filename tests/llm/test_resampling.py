"""Importance resampling against a plain version that makes every n-gram string."""

import hashlib
import math
import random
import re
import zlib

import pytest

from corpuskiln.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    ws = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def plain(docs, target, buckets=10_000, least=20, percent=25):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text, 2)[1]:
                counts[crc(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, fit = [], []
    for i, text in docs:
        ws, fs = features(text, 2)
        weight = sum(gain[crc(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None])
        if len(ws) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(fit[: len(fit) * percent // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def texts(n, seed=3):
    rnd = random.Random(seed)
    words = ["The", "of", "é", "日本", "x1", "Licence", "a" * 70, "B2b", "K", "İ"]
    return [(i, rnd.choice([" ", "\n", ", ", "\t. "]).join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 19, 20, 60])))) for i in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_crcs_of_runs_come_from_their_words(longest):
    for _, text in texts(40):
        want = [zlib.crc32(f.encode()) for f in features(text, longest)[1]]
        assert R.feature_crcs(text.encode(), longest)[0].tolist() == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(t for _, t in texts(40)).encode()
    whole = R.feature_crcs(text)[0].tolist()
    monkeypatch.setattr(R, "PIECE", 7)
    assert R.feature_crcs(text)[0].tolist() == whole
    assert R.feature_crcs(b"w" * 100)[0].tolist() == [zlib.crc32(b"w" * 100)]


def test_equals_plain_version(spark):
    docs = texts(120) + [(None, "one two " * 30), (5, None), (7, ""), (3, "one two " * 30), (3, "one two " * 30)]
    target = ["the licence of x1", None, ""]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, weight int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in R.resample(frame, bench).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == plain(docs, target)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(frame, frame.select("text")).count() == 0
    some = spark.createDataFrame(texts(30), "doc_id long, text string")
    got = [tuple(r) for r in R.resample(some, frame.select("text")).collect()]
    assert sorted(got, key=repr) == plain(texts(30), [])
