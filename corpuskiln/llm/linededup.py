"""Operator 3: lines that many documents share, dropped by probing a sharded
minimal perfect hash.

1. Each task reduces a document to its distinct long line keys; a map-side
   combined aggregation counts documents and finds the largest ``doc_id`` per
   64-bit key hash.  Hot lines are one row per task before the shuffle.
2. All distinct hashes are cut into shards by hash; a task builds one shard's
   minimal perfect hash with an array of 32-bit fingerprints, an array of
   document counts (saturated where they decide) and, for the slots whose count
   is high enough only, the keeper (the ``doc_id`` that retains the line).
3. Documents probe the arrays: fingerprint and count say whether a line is
   shared.  While all shards together stay within ``broadcast_bytes`` they are
   broadcast; beyond it, groups of probes meet one shard at a time, as many
   groups for a shard as it has probes for.  Both ways give the same rows.

Defined cases: each row is a document (a repeated row counts again); a null id
is smaller than any other; null or empty text is one empty line, which stays;
among equal largest ids all keep the line; extra columns are ignored; an empty
table gives an empty result; a very long text is read whole, line by line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm import mphf
from corpuskiln.llm.common import in_batches, load, mix, raw_texts, row_key, settle, signed

#: Keys of one shard, and bytes of all shards up to which they are broadcast.
SHARD_KEYS, BROADCAST_BYTES = 200_000, 64 << 20
#: Probes of one group when shards aren't broadcast.
GROUP_PROBES = 500_000
LOWEST = -(2**63)
_STRIP = b" \t\n\v\f\r"
_LEAD = re.compile(rb"[\x80-\xbf]+")


def line_hashes(text: bytes | None, least: int) -> tuple[list[bytes], np.ndarray]:
    """The lines, and each one's key hash (0 where the key is shorter than ``least`` code points)."""
    lines = (text or b"").split(b"\n")
    out = np.zeros(len(lines), np.uint64)
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip(_STRIP).lower()  # bytes.lower touches A-Z alone
            if len(key) >= least and (key.isascii() or len(_LEAD.sub(b"", key)) >= least):
                out[i] = xxhash.xxh3_64_intdigest(key) or 1
    return lines, out


def line_counts(docs: DataFrame, least: int) -> DataFrame:
    """(h, n_docs, keeper) of each distinct line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                found = np.unique(line_hashes(text, least)[1])
                found = found[found != 0]
                hashes.append(found)
                ids.append(np.full(len(found), LOWEST if doc_id is None else doc_id, np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hashes))), pa.array(np.concatenate(ids))], names=["h", "doc_id"])

    lines = in_batches(docs.select("doc_id", "text"), run, "h long, doc_id long")
    return lines.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


INDEX = "shard long, groups long, levels array<binary>, rest binary, prints binary, counts binary, keepers binary"


def prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(32)).astype(np.uint32)


def build_index(lines: DataFrame, documents: int) -> tuple[DataFrame, int]:
    """One row per shard, as in ``INDEX`` (``groups``: in how many its probes are dealt); and the number of shards."""
    lines = settle(lines, "lines")
    n = max(1, -(-lines.count() // SHARD_KEYS))
    group, kind = GROUP_PROBES, np.uint8 if documents < 256 else np.uint32

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["h"].to_numpy(np.int64).view(np.uint64)
        levels, rest = mphf.build(keys)
        order = np.argsort(mphf.Slots(levels, rest)(keys))
        counts = pdf["n_docs"].to_numpy(np.int64)[order]
        return pd.DataFrame([{
            "shard": int(pdf["shard"].iloc[0]), "groups": max(1, -(-int(counts.sum()) // group)), "levels": levels, "rest": rest, "prints": prints(keys[order]).tobytes(),
            "counts": np.minimum(counts, documents).astype(kind).tobytes(), "keepers": pdf["keeper"].to_numpy(np.int64)[order][counts >= documents].tobytes(),
        }])

    sharded = lines.withColumn("shard", F.pmod(F.shiftright("h", 20), F.lit(n)))
    return settle(sharded.groupBy("shard").applyInPandas(build, INDEX), "line-index", after=(lines,)), n


class Shard:
    def __init__(self, row, documents: int):
        self.slots, self.documents = mphf.Slots(list(row["levels"]), row["rest"]), documents
        self.prints, self.counts = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint8 if documents < 256 else np.uint32)
        self.shared, self.keepers = np.flatnonzero(self.counts >= documents), np.frombuffer(row["keepers"], np.int64)

    def dropped(self, hashes: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """Which hashes are lines that enough documents hold and another one keeps."""
        slot, out = self.slots(hashes), np.zeros(len(hashes), bool)
        at = np.maximum(slot, 0)
        hit = np.flatnonzero((slot >= 0) & (self.prints[at] == prints(hashes)) & (self.counts[at] >= self.documents))
        out[hit] = self.keepers[np.searchsorted(self.shared, at[hit])] != doc_ids[hit]
        return out


def _shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return np.mod(signed(hashes) >> 20, n)


SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def _rows(batch: pa.RecordBatch, drops: list[np.ndarray], lines: list[list[bytes]], keep_text: bool) -> pa.RecordBatch:
    shas, texts, n_dropped = [], [], []
    for drop, ls in zip(drops, lines):
        kept = b"\n".join([x for x, d in zip(ls, drop.tolist()) if not d]) if drop.any() else b"\n".join(ls)
        shas.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept.decode() if keep_text else None)
        n_dropped.append(int(drop.sum()))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in lines], pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def dedup_lines(docs: DataFrame, least: int = 20, documents: int = 3, keep_text: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: lines, dropped lines, the kept text's hash, the kept text (null unless asked for)."""
    spark = docs.sparkSession
    index, n = build_index(line_counts(docs, least), documents)
    parts = [c for c in index.columns if c not in ("shard", "groups", "levels")]
    weight = sum((F.length(c) for c in parts), F.aggregate("levels", F.lit(0), lambda total, x: total + F.length(x)))
    if index.select(F.coalesce(F.sum(weight), F.lit(0))).first()[0] > broadcast_bytes:
        return _by_shards(docs, index, n, least, documents, keep_text)
    shards = spark.sparkContext.broadcast(index.collect())
    opened: dict[int, Shard] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened.update({row["shard"]: Shard(row, documents) for row in shards.value})
        for batch in batches:
            parts = [line_hashes(text, least) for text in raw_texts(batch.column("text"))]
            ids = [LOWEST if x is None else x for x in batch.column("doc_id").to_pylist()]
            every = np.concatenate([h for _, h in parts]) if parts else np.zeros(0, np.uint64)
            doc = np.repeat(np.array(ids, np.int64), [len(h) for _, h in parts])
            out, probes = np.zeros(len(every), bool), np.flatnonzero(every)
            at = _shard_of(every[probes], n)
            order = np.argsort(at, kind="stable")
            probes, at = probes[order], at[order]
            first = np.flatnonzero(np.r_[True, np.diff(at) != 0]) if len(at) else at
            for s, mine in zip(at[first].tolist(), np.split(probes, first[1:])):
                out[mine] = opened[s].dropped(every[mine], doc[mine])
            drops = np.split(out, np.cumsum([len(h) for _, h in parts])[:-1]) if parts else []
            yield _rows(batch, drops, [x for x, _ in parts], keep_text)

    return in_batches(docs.select("doc_id", "text"), run, SCHEMA)


def _by_shards(docs: DataFrame, index: DataFrame, n: int, least: int, documents: int, keep_text: bool) -> DataFrame:
    """The way beyond the broadcast limit: probes go to shards, those of a shard in groups, so that a hot line's split.
    A shard is copied for its groups alone, so copies grow with the probes."""
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    groups = np.ones(n, np.int32)
    for row in index.select("shard", "groups").collect():  # a number per SHARD_KEYS lines
        groups[row["shard"]] = row["groups"]
    dealt = docs.sparkSession.sparkContext.broadcast(groups)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, hashes = [], [], []
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), raw_texts(batch.column("text"))):
                found = np.unique(line_hashes(text, least)[1])
                found = found[found != 0]
                hashes.append(found)
                keys.append(np.full(len(found), key, np.int64))
                ids.append(np.full(len(found), LOWEST if doc_id is None else doc_id, np.int64))
            if keys:
                h, key = np.concatenate(hashes), np.concatenate(keys)
                shard = _shard_of(h, n)
                part = np.mod(key, dealt.value[shard])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part), pa.array(key), pa.array(np.concatenate(ids)), pa.array(signed(h))], names=["shard", "part", "key", "doc_id", "h"])

    asked = in_batches(keyed, probes, "shard long, part long, key long, doc_id long, h long")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": pd.Series([], dtype="int64"), "h": pd.Series([], dtype="int64")})
        hashes = left["h"].to_numpy(np.int64).view(np.uint64)
        hit = Shard(right.iloc[0], documents).dropped(hashes, left["doc_id"].to_numpy(np.int64))
        return left.loc[hit, ["key", "h"]].drop_duplicates()

    hits = asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(probe, "key long, h long")
    per_doc = hits.groupBy("key").agg(F.collect_list("h").alias("drop"))
    joined = keyed.join(per_doc, "key", "left").select("doc_id", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [line_hashes(text, least) for text in raw_texts(batch.column("text"))]
            drops = [np.isin(signed(h), np.array(d or [], np.int64)) & (h != 0) for (_, h), d in zip(parts, batch.column("drop").to_pylist())]
            yield _rows(batch, drops, [x for x, _ in parts], keep_text)

    return in_batches(joined, run, SCHEMA)


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, i, line, s.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN shared s ON keyed.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
