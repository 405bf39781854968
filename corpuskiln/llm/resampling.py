"""Operator 12: importance resampling towards a target text, by the algebra of CRC-32.

Features are all runs of 1 to ``LONGEST`` consecutive words, joined by one space;
a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  A word's CRC is
computed once per task; the CRC of a longer run comes from its parts, because
appending n bytes multiplies a CRC by a fixed 32 x 32 matrix over GF(2):
``crc(ab) = shift(crc(a), len(b)) ^ crc(b)``.  The matrices of 1, 2, 4, ... bytes are
kept as byte tables, so a whole text is shifted by a few table look-ups, and no
n-gram string is ever made.

Two narrow passes: one counts buckets of the corpus and of the target (a task sends
``BUCKETS`` sums at most), the other weighs each document by the mean gain of its
features.  The highest sums of weight and seeded Gumbel noise are drawn, which is
sampling without replacement in proportion to the importance.  Ranks come from a
range partitioning, each partition numbering its rows after those before it.

Defined cases: null and empty texts have no features and weight 0; a null id is the
empty text in the seed and comes last among ties; rows equal in id and score are
ordered by their number of features; very long texts are read in pieces, words kept
whole; empty tables give an empty result, an empty target gains nothing but what
the add-one counts say; extra columns are ignored by ``weighed`` and by the query.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import in_batches, load, numbered, raw_texts, settle

LONGEST, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of a text that are turned into words at a time.
PIECE = 1 << 20
_POLY = 0xEDB88320
#: Bytes of words as they count (A-Z lowered), others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _matrices(most: int = 32) -> np.ndarray:
    """Byte tables of the matrices that shift a CRC by 1, 2, 4, ... bytes: [k, byte number, byte value]."""
    step = np.arange(256, dtype=np.uint32)  # one zero byte after each of 256 low bytes
    for _ in range(8):
        step = np.where(step & np.uint32(1), (step >> np.uint32(1)) ^ np.uint32(_POLY), step >> np.uint32(1))
    low = np.arange(256, dtype=np.uint32)
    tables = [np.stack([step, *(low << np.uint32(8 * (j - 1)) for j in range(1, 4))])]
    for _ in range(most - 1):  # twice as many bytes: the matrix squared
        tables.append(_times(tables[-1], tables[-1]))
    return np.stack(tables)


def _times(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return table[0][crcs & 255] ^ table[1][(crcs >> 8) & 255] ^ table[2][(crcs >> 16) & 255] ^ table[3][crcs >> 24]


_SHIFTS = _matrices()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What these CRCs become when so many bytes follow, before the CRC of those bytes is added."""
    out = crcs.astype(np.uint32, copy=True)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = np.flatnonzero((lengths >> k) & 1)
        out[on] = _times(_SHIFTS[k], out[on])
    return out


class Words(dict):
    """word -> its CRC and length in one number; emptied when full, which only costs time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = zlib.crc32(word) | len(word) << 32
        return found


_WORDS = Words()


def word_crcs(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """CRCs and lengths of a text's words."""
    text, parts, at = text or b"", [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):  # up to the end of a word
            found = _END.search(text, end)
            end = found.start() if found else len(text)
        words = text[at:end].translate(_TABLE).split()
        parts.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
        at = end
    packed = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.int64)


_END = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def feature_crcs(text: bytes | None, longest: int = LONGEST) -> tuple[np.ndarray, int]:
    """CRCs of all runs of 1 to ``longest`` words of a text, and its number of words."""
    crcs, lengths = word_crcs(text)
    runs, out = crcs, [crcs]
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
    for n in range(2, min(longest, len(crcs)) + 1):
        opened = shifted(runs[:-1], np.broadcast_to(one, len(runs) - 1)) ^ space
        runs = shifted(opened, lengths[n - 1 :]) ^ crcs[n - 1 :]
        out.append(runs)
    return np.concatenate(out), len(crcs)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in raw_texts(batch.column(0)):
                crcs, _ = feature_crcs(t, longest)
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = in_batches(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # a row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of its add-one shares, floored."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda a, b: (float(a) + 1.0) * float(s + n) / ((float(b) + 1.0) * float(t + n))
    return np.array([math.floor(1000.0 * math.log(ratio(a, b))) for a, b in zip(target.tolist(), corpus.tolist())], np.int64)


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: the floored mean gain of its features."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in raw_texts(batch.column(1)):
                crcs, words = feature_crcs(t, longest)
                total = int(gain.value[crcs % np.uint32(buckets)].sum())
                rows.append((words, len(crcs), total // len(crcs) if len(crcs) else 0))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], names=["doc_id", "n_words", "n_features", "weight"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, the same in every run."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank of the drawn documents, else null."""
    fit = F.col("n_words") >= least_words
    most = scored.filter(fit).count() * percent // 100
    cols = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features")]
    ranked = numbered(scored.filter(fit).select(*cols), order, "rank")
    kept = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return kept.unionByName(scored.filter(~fit).select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Each document's weight towards the target, its score, and its rank if it is drawn."""
    scored = weighed(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(settle(scored, "scored"), least_words, percent)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(text: str) -> str:
    """DuckDB's words for the CRC-32 of a string's bytes: one table look-up a byte."""
    table = "[" + ", ".join(str(int(x)) for x in _SHIFTS[0][0]) + "]"
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


OP12_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bench AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
df AS (SELECT k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM docs),
bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM bench),
dn AS (SELECT k, f, count(*) AS n FROM df GROUP BY ALL),
bn AS (SELECT f, count(*) AS n FROM bf GROUP BY f),
names AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS b FROM (SELECT f FROM dn UNION SELECT f FROM bn)),
s AS (SELECT b, sum(n)::BIGINT AS n FROM dn JOIN names USING (f) GROUP BY b),
t AS (SELECT b, sum(n)::BIGINT AS n FROM bn JOIN names USING (f) GROUP BY b),
g AS (
  SELECT s.b, floor(1000.0::DOUBLE * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT sum(n) FROM s)::DOUBLE + {BUCKETS}) / ((s.n::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.b = t.b),
w AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dn JOIN names USING (f) JOIN g USING (b) GROUP BY k),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN w USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= (SELECT count(*) FROM docs WHERE len(ws) >= {LEAST_WORDS}) * {PERCENT} // 100 THEN r END::BIGINT AS rank FROM ranked
"""
