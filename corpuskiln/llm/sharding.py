"""Operator 4: byte-limited shards by extendible hashing.

A document's hash is 60 bits of md5 over id and text digest.  The directory is
grown by rounds: bytes are summed by the next ``STEP`` prefix bits (map-side
combined, so a hot prefix is one row per task), and each bucket above the limit
splits on one more bit until it fits.  Only documents in buckets that are still
too large after a round take part in the next, with the following bits.  Leaves
are found for the hashes alone; texts are joined once, with a broadcast table
while one round is enough.

A bucket that can't be split - a single document above the limit, or rows equal
in id and text - becomes a shard of its own at full depth with ``oversized``
true.  Null ids and texts hash like absent ones and weigh 0 bytes for a null
text; repeated rows share a shard; an empty table gives no shards; columns of
the input named like the added ones are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import columns, fresh, load, settle

BITS, STEP = 60, 12
LIMIT = 1 << 20
ADDED = ("shard_id", "depth", "shard_docs", "shard_bytes", "oversized")


def hash_bits() -> Column:
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5("text")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _split(limit: int, depth: int):
    """Leaves of one bucket, from the bytes below each prefix of STEP more bits (at most 2**STEP rows)."""
    last = depth + STEP >= BITS

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, work = [], [(0, pdf.sort_values("prefix"))]
        while work:
            more, part = work.pop()
            total, docs = int(part["bytes"].sum()), int(part["docs"].sum())
            if total <= limit or (more == STEP and last):
                rows += [(p, depth + more, docs, total) for p in part["prefix"]]
            elif more == STEP:
                rows += [(p, None, docs, total) for p in part["prefix"]]
            else:
                bit = (part["prefix"] // 2 ** (STEP - more - 1)) % 2
                work += [(more + 1, part[bit == b]) for b in (0, 1) if (bit == b).any()]
        return pd.DataFrame(rows, columns=["prefix", "depth", "shard_docs", "shard_bytes"]).astype({"depth": "Int32"})

    return split


def directory(sized: DataFrame, limit: int) -> list[DataFrame]:
    """One table per round: (prefix, depth, shard_docs, shard_bytes), by prefixes of STEP,
    2*STEP, ... bits; depth is null where the next round goes on.  ``sized`` has bits, bytes."""
    rounds, open_ = [], sized
    for depth in range(0, BITS, STEP):
        at = F.shiftright("bits", BITS - depth - STEP)
        sums = open_.groupBy(at.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        parts = sums.groupBy(F.shiftright("prefix", STEP).alias("root")).applyInPandas(_split(limit, depth), "prefix long, depth int, shard_docs long, shard_bytes long")
        parts = settle(parts, "shard-directory")
        rounds.append(parts)
        more = parts.filter("depth IS NULL").select(F.col("prefix").alias("open_prefix"))
        if more.isEmpty():
            break
        open_ = open_.join(more, at == F.col("open_prefix"), "left_semi")
    return rounds


def leaves(sized: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The leaf (prefix or bits, depth, docs, bytes) of each hash, and whether it is found by the first ``STEP`` bits.

    A directory of one round has 2**STEP leaves at most.  A deeper one is resolved on distinct hashes, which are
    narrow, round by round; texts aren't touched."""
    rounds = directory(sized, limit)
    named = [p.filter("depth IS NOT NULL").select("prefix", F.struct("depth", "shard_docs", "shard_bytes").alias("leaf")) for p in rounds]
    if len(named) == 1:
        return named[0].select(F.col("prefix").alias("at"), "leaf.*"), True
    open_, found = sized.select("bits").distinct(), None
    for i, part in enumerate(named):
        prefix = F.shiftright("bits", BITS - STEP * (i + 1))
        met = open_.join(F.broadcast(part) if i == 0 else part, prefix == part["prefix"], "left").drop("prefix")
        met = settle(met, "placed")
        here = met.filter("leaf IS NOT NULL").select(F.col("bits").alias("at"), "leaf.*")
        found = here if found is None else found.unionByName(here)
        open_ = met.filter("leaf IS NULL").select("bits")
    return found, False


def assign_shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with shard_id (the prefix bits as text), depth, shard_docs, shard_bytes, oversized."""
    docs = docs.drop(*ADDED)
    sized = settle(docs.select(hash_bits().alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "sized")
    found, shallow = leaves(sized, limit)
    bits, at, depth, n, size = fresh(docs, "bits", "at", "leaf_depth", "leaf_docs", "leaf_bytes")
    found = found.toDF(at, depth, n, size)
    hashed = docs.withColumn(bits, hash_bits())
    if shallow:
        out = hashed.join(F.broadcast(found), F.shiftright(bits, BITS - STEP) == found[at])
    else:
        out = hashed.join(found, hashed[bits] == found[at])
    name = F.substring(F.lpad(F.bin(bits), BITS, "0"), F.lit(1), F.col(depth))
    added = (name.alias("shard_id"), F.col(depth).alias("depth"), F.col(n).alias("shard_docs"), F.col(size).alias("shard_bytes"), (F.col(size) > limit).alias("oversized"))
    return out.select(*columns(docs), *added)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = assign_shards(docs)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard_id", F.col("depth").cast("long").alias("depth"), "shard_docs", "shard_bytes", "oversized")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(concat_ws('|', doc_id, md5(text))), 1, 15))::BIGINT AS bits FROM documents),
levels AS (SELECT d.*, l::INT AS depth, bits >> ({BITS} - l)::INT AS prefix FROM d, generate_series(0, {BITS}) g(l)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM levels GROUP BY 1, 2),
leaf AS (
  SELECT doc_id, n_bytes, bits, coalesce(min(depth) FILTER (shard_bytes <= {LIMIT}), {BITS}) AS depth
  FROM levels JOIN sums USING (depth, prefix) GROUP BY doc_id, n_bytes, bits)
SELECT doc_id, n_bytes, substr(lpad(bin(bits), {BITS}, '0'), 1, leaf.depth) AS shard_id, leaf.depth::BIGINT AS depth,
       shard_docs, shard_bytes, shard_bytes > {LIMIT} AS oversized
FROM leaf JOIN sums ON sums.depth = leaf.depth AND sums.prefix = (bits >> ({BITS} - leaf.depth)::INT)
"""
