"""Operator 7: sources mixed to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 5, 2, 1 repeating and
share 150 % of all words; a target stops at twice its source's size and the
excess is shared again by weight.  A document is then taken ``floor(r)`` times
for sure and once more with probability ``r - floor(r)``, r being target over
source size.  That last copy is chosen by balanced sampling: the inclusion
probabilities move along the null space of two constraints (words and
documents of the source) until they are 0 or 1, three documents at a time.

Groups: the flight phase runs by (source, bucket of about ``GROUP`` documents);
each group leaves at most ``LANDING`` fractional documents, which meet in
``FAN`` times fewer groups in the next round, until one small landing problem
per source is left, solved by trying all its outcomes.  A hot source is thus
many groups.  Buckets come from row hashes, so reruns agree on any layout.

Defined cases: null text has size 0; a source of size 0 has target 0 and takes
nothing; repeated rows are separate documents, which are flown as a count; an empty
table gives an empty result; very long texts are only counted; extra columns are ignored by ``mix`` and kept by ``mixed``, whatever
their names.  The number of sources may grow with the input (web hosts): their
order and targets are found by Spark, the driver sees a few sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import columns, fresh, load, settle, spread

GROUP, FAN, LANDING = 2000, 64, 12
SHARE, CAP, WEIGHTS = 1.5, 2.0, (5, 2, 1)
#: Rows that one row is turned into by one task.
COPIES = 1000
_EPS = 1e-9
_OUTCOMES = ((np.arange(1 << LANDING)[:, None] >> np.arange(LANDING)) & 1).astype(np.float64)


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs), a row per source.

    Sources get their place in the order from a range partitioning.  With L words a unit of weight, a source takes
    L * weight or, if that is above it, its cap; L grows in rounds, one aggregation each, until no source passes
    its cap any more - only sums of a round reach the driver."""
    spark = totals.sparkSession
    order = [F.col("source").isNull(), F.col("source")]  # code points, null last
    placed = totals.repartitionByRange(spread(totals), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = settle(placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}), "sources")
    before, offsets = 0, []
    for row in sorted(placed.groupBy("part").count().collect(), key=lambda r: r["part"]):  # one row per partition
        offsets.append((row["part"], before % len(weights)))
        before += row["count"]
    offset = spark.createDataFrame(offsets, "part long, offset long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("at") + F.col("offset"), F.lit(len(weights))).cast("int") + 1)
    placed = settle(placed.join(F.broadcast(offset), "part").select("source", "source_size", "docs", weight.alias("weight")), "weights", after=(placed,))
    most, words, unit, capped = F.col("source_size") * F.lit(float(cap)), None, 0.0, -1
    while True:
        above = most < F.lit(unit) * F.col("weight")
        row = placed.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(above, 1)).alias("capped"),
        ).first()
        words = share * (row["all"] or 0)
        if row["capped"] == capped or not row["weight"]:
            break
        unit, capped = (words - row["fixed"]) / row["weight"], row["capped"]
    return placed.select("source", "source_size", "docs", F.least(most, F.lit(unit) * F.col("weight")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = LANDING) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping sum(p) and sum(p * size), until at most ``leave`` (>= 2) are between."""
    p = [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else float(x) for x in p]
    z = size.astype(float).tolist()
    free = [i for i, x in enumerate(p) if 0 < x < 1]
    draws = rng.random(len(free) + 1).tolist()
    queue, hand = free[::-1], []
    while len(queue) + len(hand) > max(2, leave):
        while len(hand) < 3:
            hand.append(queue.pop())
        a, b, c = hand
        u = (z[b] - z[c], z[c] - z[a], z[a] - z[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for i, v in zip(hand, u):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, -p[i] / v), min(down, (p[i] - 1) / v)
        move = up if draws.pop() * (up + down) < down else -down
        for i, v in zip(hand, u):
            x = p[i] + move * v
            p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        hand = [i for i in hand if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The outcome of what is left that comes nearest in words, then in documents, then first."""
    free = np.flatnonzero((p > 0) & (p < 1))
    if not len(free):
        return p
    tries = _OUTCOMES[: 1 << len(free), : len(free)]
    off = np.abs(tries @ size[free] - p[free] @ size[free])
    count = np.abs(tries.sum(1) - p[free].sum())
    p = p.copy()
    p[free] = tries[np.lexsort((np.arange(len(tries)), count, np.round(off, 6)))[0]]
    return p


def _same(docs: DataFrame, names: list[str]) -> Column:
    """A hash of these columns, nulls included."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    parts = []
    for n in names:
        c = F.col(f"`{n}`")
        parts += [F.isnull(c), F.to_json(F.struct(c)) if "map<" in kinds[n].simpleString() else c]
    return F.xxhash64(*parts)


def chosen(docs: DataFrame, like: tuple[str, ...] = ("doc_id", "text", "source")) -> DataFrame:
    """(doc_id, source, key, copies, size, source_size, target, sure, extra), a row per distinct document: each of its ``copies``
    is taken ``sure`` times and ``extra`` of them once more. ``key`` is a hash of the columns ``like``.

    Copies are alike in every constraint, so moving their probabilities against each other ends with whole copies and one
    fractional one; that one alone flies on, and a row that is repeated a billion times costs as much as one row."""
    words = F.expr(r"size(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0))").cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _same(docs, list(like)).alias("key"), words.alias("size"))
    sized = settle(sized.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("copies")), "sized")
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("docs"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP)).cast("long")
    sources = settle(targets(settle(totals, "totals")).select("source", "source_size", "target", ratio.alias("ratio"), buckets.alias("buckets")), "sources")
    # few sources are broadcast by Spark, which knows the size of the settled table; a hot one among many is split by it
    units = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    sure = F.least(F.floor(F.col("ratio") + _EPS), F.lit(int(CAP)))
    units = units.withColumn("sure", sure).withColumn("all", F.col("copies") * F.greatest(F.lit(0.0), F.col("ratio") - F.col("sure")))
    units = units.withColumn("extra", F.floor(F.col("all") + _EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("all") - F.col("extra"))).withColumn("bucket", F.pmod("key", F.col("buckets")))
    most = sources.agg(F.coalesce(F.max("buckets"), F.lit(1))).first()[0]
    schema = "source string, doc_id long, key long, copies long, size long, source_size long, target double, buckets long, sure long, extra long, p double, bucket long"
    cols = [c.split()[0] for c in schema.split(", ")]

    def fly(last: bool, turn: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "size", "doc_id"], ignore_index=True)
            seed = xxhash.xxh3_64_intdigest(f"{pdf['source'].iloc[0]}|{pdf['bucket'].iloc[0]}|{turn}".encode())
            p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy()
            p = flight(p, size, np.random.default_rng(seed))
            return pdf.assign(p=landing(p, size) if last else p)[cols]

        return run

    done, open_, turn = [], units.select(*cols), 0
    while True:
        last = most <= 1
        flown = open_.groupBy("source", "bucket").applyInPandas(fly(last, turn), schema)
        if last:
            done.append(flown)
            break
        flown = settle(flown, "flown")
        done.append(flown.filter("p = 0 OR p = 1"))
        open_ = flown.filter("p > 0 AND p < 1")
        most, turn = -(-most // FAN), turn + 1
        open_ = open_.withColumn("bucket", F.floor(F.col("bucket") / F.lit(FAN)).cast("long"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "key", "copies", "size", "source_size", "target", "sure", (F.col("extra") + F.col("p").cast("long")).alias("extra"))


def mix(docs: DataFrame, like: tuple[str, ...] = ("doc_id", "text", "source")) -> DataFrame:
    """(doc_id, source, key, nth, size, source_size, target, times, taken), a row per document; ``nth`` numbers
    rows that agree in the columns ``like``. Rows of many copies are told off in blocks of ``COPIES`` by several tasks."""
    rows = settle(chosen(docs, like), "chosen")
    told = lambda df, first, last: df.withColumn("nth", F.explode(F.sequence(first, last)))
    out = told(rows.filter(F.col("copies") <= COPIES), F.lit(1).cast("long"), F.col("copies"))
    many = rows.filter(F.col("copies") > COPIES)
    if not many.isEmpty():
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
        blocks = many.withColumn("block", block).repartition(spread(docs), "key", "block")
        at = F.col("block") * COPIES
        out = out.unionByName(told(blocks, at + 1, F.least(F.col("copies"), at + COPIES)).drop("block"))
    times = (F.col("sure") + (F.col("nth") <= F.col("extra")).cast("int")).cast("long")
    return out.select("doc_id", "source", "key", "nth", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it was taken.

    Rows that agree in all columns are one row that is taken so many times, so whole texts are shuffled once, with
    equal rows combined in the task.  A row taken more than ``COPIES`` times is multiplied by several tasks."""
    key, who, times, block = fresh(docs, "key", "who", "times", "block")
    names = docs.columns
    lowest = F.lit(-(2**63))
    one = docs.withColumns({key: _same(docs, names), who: F.coalesce(F.col("doc_id").cast("long"), lowest)}).dropDuplicates([key, who])
    total = F.sum(F.col("copies") * F.col("sure") + F.col("extra")).cast("long")
    taken = chosen(docs, tuple(names)).groupBy(F.col("key").alias(key), F.coalesce("doc_id", lowest).alias(who)).agg(total.alias(times)).filter(F.col(times) > 0)
    taken = settle(taken, "taken")
    repeat = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    few = one.join(taken.filter(F.col(times) <= COPIES), [key, who])
    out = few.withColumn(block, repeat(F.col(times))).select(*columns(docs))
    many = taken.filter(F.col(times) > COPIES)
    if many.isEmpty():
        return out
    blocks = one.join(many, [key, who]).withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / COPIES))))
    blocks = blocks.repartition(spread(docs), key, block)
    return out.unionByName(blocks.withColumn(block, repeat(F.least(F.lit(COPIES), F.col(times) - F.col(block) * COPIES))).select(*columns(docs)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
