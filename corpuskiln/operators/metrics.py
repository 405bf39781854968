"""Quality analytics: confusion, per-class scores, frequency tables, quartiles, phrase mining."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.sources.tables import written


def frequency(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))  # one row
    out = counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("n") / F.col("_all"), 2)).drop("_all")
    return out.orderBy(F.col("n").desc(), column).limit(n) if n else out


def tallies(df: DataFrame, flags: list[str], scores: list[str] = ()) -> DataFrame:
    """One row: how often each flag is true, and the mean of each score."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags], *[F.round(F.avg(s), 4).alias(s) for s in scores])


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.filter(F.col(gold).isNotNull() & (F.col(gold) != "")).groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class: support, predicted, tp, precision, recall, f1 (each rounded to 3)."""
    table = confusion(df, gold, predicted)
    support = table.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    called = table.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    both = support.join(called, "label", "full").fillna(0)
    p = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return both.select("label", "support", "n_predicted", "tp", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f, 3).alias("f1"))


def overall_scores(per_class: DataFrame) -> DataFrame:
    """Micro accuracy, macro and weighted scores from per-class rows."""
    return per_class.agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("micro_accuracy"),
        F.round(F.avg("precision"), 4).alias("macro_precision"),
        F.round(F.avg("recall"), 4).alias("macro_recall"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
    )


def top_confusions(df: DataFrame, gold: str, predicted: str, n: int = 10) -> DataFrame:
    return confusion(df, gold, predicted).filter("gold != predicted").orderBy(F.col("n").desc(), "gold", "predicted").limit(n)


def exclusive_quartiles(df: DataFrame, by: str, value: str, whole: int = 200_000, accuracy: int = 10_000) -> DataFrame:
    """Quartiles by the exclusive rule: position k*(n+1)/4, clamped to the data, interpolated.

    No group is sorted whole.  Approximate percentiles, whose error in rank is known, give a stretch of values around
    each quartile (for groups of up to ``whole`` rows: all of them); what lies below it is counted, and only the
    distinct values of the stretch are put in order."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("v"))
    e = 4.0 / accuracy
    edges = [min(max(k / 4 + d, 0.0), 1.0) for k in (1, 2, 3) for d in (-e, e)]
    stats = rows.groupBy("_by").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", edges, accuracy).alias("p"))
    m = lambda k: F.lit(k) * (F.col("n") + 1)
    j = lambda k: F.greatest(F.lit(1), F.least(F.floor(m(k) / 4), F.col("n") - 1))
    small = F.col("n") <= max(whole, 2 * accuracy)
    part = lambda k: F.struct(F.lit(k).alias("k"), j(k).alias("j"), (m(k) - 4 * j(k)).alias("d"), F.when(small, F.col("low")).otherwise(F.col("p")[2 * k - 2]).alias("from"), F.when(small, F.col("high")).otherwise(F.col("p")[2 * k - 1]).alias("to"))
    asked = stats.select("_by", F.explode(F.array(*[part(k) for k in (1, 2, 3)])).alias("q")).select("_by", "q.*")
    counts = rows.groupBy("_by", "v").agg(F.count("*").alias("c"))
    met = counts.join(asked, "_by").filter(F.col("v") <= F.col("to"))
    inside = F.when(F.col("v") >= F.col("from"), F.col("v"))  # null: all values below, as one row
    met = met.groupBy("_by", "k", "j", "d", inside.alias("v")).agg(F.sum("c").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy("_by", "k").orderBy(F.col("v").asc_nulls_first()))
    at = lambda i: F.max(F.when((F.col("up_to") >= i) & (F.col("up_to") - F.col("c") < i), F.col("v")))
    pairs = met.withColumn("up_to", up_to).groupBy("_by", "k").agg(at(F.col("j")).alias("lo"), at(F.col("j") + 1).alias("hi"), F.max("d").alias("d"))
    mean = F.round(F.coalesce((F.col("lo") * (4 - F.col("d")) + F.col("hi") * F.col("d")) / 4, F.col("lo")), 6)
    found = pairs.groupBy("_by").agg(*[F.max(F.when(F.col("k") == k, mean)).alias(f"q{k}") for k in (1, 2, 3)])
    return stats.select("_by", "n", "mean", "low", "high").join(found, "_by").withColumnRenamed("_by", by)


def _gram(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i + 1, n), " ")


def ngrams(words: Column, longest: int = 3) -> Column:
    """All 1..longest-grams of a word array, joined by spaces."""
    parts = []
    for n in range(1, longest + 1):
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), _gram(words, n))
        parts.append(F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


#: Slots of the sieve of frequent parts: 2 MB, however many parts there are.
SLOTS = 1 << 24


#: Samples whose phrases a task makes at once.
PIECE = 64


def sieve(phrases: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """A bit for the hash of each phrase (column ``phrase``). What isn't in the table may pass, what is always does."""
    slot = F.pmod(F.xxhash64("phrase"), F.lit(slots)) + 1  # numbers of bits count from 1
    bits = phrases.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = np.zeros(slots, bool)
    for row in bits.collect():  # 4 KB a bucket of 32768 bits
        held = np.flatnonzero(np.unpackbits(np.frombuffer(row["m"], np.uint8), bitorder="little"))
        out[(row["b"] - 1) * 32768 + held] = True
    return out


def _slot(phrase: str, slots: int) -> int:
    h = xxhash.xxh64_intdigest(phrase.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % slots


def _grown(samples: DataFrame, words: str, n: int, passed: np.ndarray) -> DataFrame:
    """(y, phrase): the distinct n-grams of each sample both of whose (n-1)-grams pass the sieve."""
    sent, slots = samples.sparkSession.sparkContext.broadcast(np.packbits(passed)), len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.unpackbits(sent.value).astype(bool)[:slots], {}
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):  # words of few texts at a time are objects
            ys, grams = [], []
            for y, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [" ".join(ws[i : i + n - 1]) for i in range(len(ws or ()) - n + 2)]
                if len(known) > 1 << 18:
                    known.clear()
                good = [known[p] if p in known else known.setdefault(p, bits[_slot(p, slots)]) for p in parts]
                mine = {f"{p} {ws[i + n - 1]}" for i, p in enumerate(parts[:-1]) if good[i] and good[i + 1]}
                grams += mine
                ys += [y] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(grams, pa.string())], names=["_y", "phrase"])

    return samples.select("_y", words).mapInArrow(run, "_y int, phrase string")


def mined_phrases(samples: DataFrame, words: str, target: Column, longest: int = 3, support: int = 5, precision: float = 0.70, candidates: int = 400, keep: int = 12, least: int = 4) -> DataFrame:
    """Phrases that predict ``target``: support, precision and lift over the base rate.

    A phrase counts once per sample; of the most common ``candidates`` phrases
    of target samples (a report's size) the best ``keep`` are returned.

    Phrases grow level by level.  One that ``support`` target samples hold has only parts that so many hold, so words
    are counted first, pairs are made only where both words are that frequent, and triples only where both pairs are; what
    is frequent reaches the tasks as a sieve of bits.  Rare phrases, which are nearly all, are never shuffled."""
    marked = samples.select(target.cast("int").alias("_y"), F.col(words).alias("_w"))
    base = marked.agg(F.avg("_y").alias("base"))
    grams = marked.select("_y", F.explode(F.array_distinct("_w")).alias("phrase"))
    levels = []
    for n in range(1, longest + 1):
        counts = grams.groupBy("phrase").agg(F.count("*").alias("n"), F.sum("_y").alias("hits")).filter(F.col("hits") >= support)
        levels.append(written(counts, name="phrases"))
        if n < longest:
            grams = _grown(marked, "_w", n + 1, sieve(levels[-1]))
    every = reduce(DataFrame.unionByName, levels).filter(F.length("phrase") >= least)
    common = every.orderBy(F.col("hits").desc(), "phrase").limit(candidates)
    scored = common.crossJoin(F.broadcast(base)).withColumn("precision", F.round(F.col("hits") / F.col("n"), 6))
    scored = scored.withColumn("lift", F.round(F.col("hits") / F.col("n") / F.col("base"), 6)).filter(F.col("precision") >= precision)
    return scored.orderBy(F.col("lift").desc(), F.col("precision").desc(), F.col("hits").desc(), "phrase").limit(keep).select("phrase", F.col("hits").alias("support"), "n", "precision", "lift")
