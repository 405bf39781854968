"""Operator 9: benchmark decontamination by greedy string tiling.

Texts are lists of case-folded words (letters, digits and underscores of any
script).  A task rolls a Karp-Rabin print over
each ``LEAST`` words of a document and looks the prints up among those of the
benchmark items: shared prints are seeds, and seeds that follow one another on
a diagonal are maximal matches.  Greedy tiling then marks the longest match
that touches no marked word, shortening what it overlaps, until none of
``LEAST`` words is left.  An item's coverage is the share of its words under
tiles; tiles may come in any order, so reordered passages count.  A document
is contaminated by the items covered to ``THRESHOLD`` or more.

The benchmark is used in blocks of at most about ``BLOCK_BYTES`` of text, each
broadcast for one narrow pass over all documents; nothing of a document is
shuffled while one block holds the whole benchmark.

Defined cases: items of fewer than ``LEAST`` words or null text match nothing;
null and empty documents are clean; equal items are all reported; repeated
rows are judged alike; extra columns are kept by ``clean`` and ignored
otherwise; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.llm.common import WORD_NAMES, columns, fresh, in_batches, load, raw_texts, row_key, settle, window_prints

LEAST, THRESHOLD = 5, 0.5
BLOCK_BYTES = 16 << 20
#: Pairs of equal windows that a task holds at once.
PAIRS = 2_000_000
_WORD = re.compile(r"\w+")
_SIEVE = 1 << 22

HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())]))


def word_names(text: bytes | None) -> np.ndarray:
    return WORD_NAMES.of(_WORD.findall((text or b"").decode().casefold()))


class Seeds:
    """Prints of all LEAST-word windows of some items, with their places."""

    def __init__(self, items: list[tuple[int, bytes]], least: int = LEAST):
        self.least, self.items = least, [(i, word_names(t)) for i, t in items if t is not None]
        prints = [window_prints(n, least) for _, n in self.items]
        every = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        place = np.concatenate([np.arange(len(p)) for p in prints]) if prints else item
        order = np.argsort(every, kind="stable")
        self.prints, self.item, self.place = every[order], item[order], place[order]
        self.sieve = np.zeros(_SIEVE, bool)
        self.sieve[(every % np.uint64(_SIEVE)).astype(np.int64)] = True

    def hits(self, names: np.ndarray) -> list[tuple[int, float, int]]:
        """(item id, coverage, tiles) of each item that shares a seed with the document."""
        prints = window_prints(names, self.least)
        maybe = np.flatnonzero(self.sieve[(prints % np.uint64(_SIEVE)).astype(np.int64)]) if len(self.prints) else []
        if not len(maybe):
            return []
        lo, hi = np.searchsorted(self.prints, prints[maybe], "left"), np.searchsorted(self.prints, prints[maybe], "right")
        maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
        found = []
        if (hi - lo).sum() <= PAIRS:
            spots = np.repeat(maybe, hi - lo)
            at = np.repeat(lo, hi - lo) + np.arange(len(spots)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            found = by_item(self.item[at], self.place[at], spots, self.least)
        else:  # repetitive texts: item by item, some diagonals at a time
            shared = np.zeros(len(self.items), bool)
            for a, b in zip(lo.tolist(), hi.tolist()):
                shared[self.item[a:b]] = True
            order = np.argsort(prints[maybe], kind="stable")
            found = [(i, long_matches(window_prints(self.items[i][1], self.least), prints[maybe][order], maybe[order], len(names), self.least)) for i in np.flatnonzero(shared)]
        out = []
        for i, runs in found:
            item_id, words = self.items[i]
            covered, tiles = tile(runs, len(words), self.least)
            if tiles:
                out.append((item_id, covered / len(words), tiles))
        return sorted(out)


def long_matches(item: np.ndarray, prints: np.ndarray, spots: np.ndarray, words: int, least: int) -> list[tuple[int, int, int]]:
    """``matches`` of one item and the sorted ``prints`` of a document, without holding more than about ``PAIRS``
    pairs of places: diagonals (spot - place) are taken in stretches, and no match spans two diagonals."""
    lo, hi = np.searchsorted(prints, item, "left"), np.searchsorted(prints, item, "right")
    places = np.flatnonzero(hi > lo)
    if not len(places):
        return []
    out, at, step = [], -len(item), max(1, PAIRS // len(places))
    while at < words:
        stop = at + step  # a place has one spot per diagonal at most
        place, spot = [], []
        for p in places.tolist():
            mine = spots[lo[p] : hi[p]]  # ascending
            mine = mine[np.searchsorted(mine, p + at) : np.searchsorted(mine, p + stop)]
            place.append(np.full(len(mine), p))
            spot.append(mine)
        out += matches(np.concatenate(place), np.concatenate(spot), least)
        at = stop
    return out


def by_item(item: np.ndarray, place: np.ndarray, spot: np.ndarray, least: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Each item's maximal matches (length, place in the item, spot in the document) from equal windows: one sort for
    all items, so many items that share a few words cost no pass each."""
    order = np.lexsort((place, spot - place, item))
    item, place, diagonal = item[order], place[order], (spot - place)[order]
    first = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(place) != 1)]) if len(place) else np.zeros(0, int)
    runs = np.diff(np.r_[first, len(place)]) + least - 1
    rows = zip(item[first].tolist(), runs.tolist(), place[first].tolist(), (place + diagonal)[first].tolist())
    return [(i, [r[1:] for r in mine]) for i, mine in groupby(rows, itemgetter(0))]


def matches(place: np.ndarray, spot: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The maximal matches of one item."""
    found = by_item(np.zeros(len(place), np.int64), place, spot, least)
    return found[0][1] if found else []


def tile(found: list[tuple[int, int, int]], words: int, least: int) -> tuple[int, int]:
    """Greedy tiling: marked words of the item, and tiles. Ties go to the first place, then spot."""
    heap = [(-n, p, s) for n, p, s in found]
    heapq.heapify(heap)
    item, text = bytearray(words), defaultdict(bool)
    tiles, left = 0, words
    while heap and left >= least:
        n, p, s = heapq.heappop(heap)
        free, run = [], 0
        for k in range(-n + 1):
            if k < -n and not item[p + k] and not text[s + k]:
                run += 1
            else:
                if run >= least:
                    free.append((run, k - run))
                run = 0
        if free and free[0][0] == -n:
            for k in range(-n):
                item[p + k], text[s + k] = 1, True
            tiles, left = tiles + 1, left + n
        else:
            for run, k in free:
                heapq.heappush(heap, (-run, p + k, s + k))
    return sum(item), tiles


def _pass(docs: DataFrame, items: list[tuple[int, bytes]], into: str) -> DataFrame:
    """``docs`` with a column of every item that shares a tile with the text."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    ready: list[Seeds] = []
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.append(Seeds(sent.value))
        for batch in batches:
            hits = [[{"item_id": i, "coverage": c, "tiles": n} for i, c, n in ready[0].hits(word_names(t))] for t in raw_texts(batch.column(at))]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=[*batch.schema.names, into])

    return in_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(into, HITS)]))


def tiled(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, into: str = "_hits") -> DataFrame:
    """``docs`` with its hits against the whole benchmark, in a column whose name must be free."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    weight = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-weight // block_bytes))
    if blocks == 1:
        return _pass(docs, [(r[0], r[1].encode()) for r in bench.collect()], into)
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    keyed, found = docs.select("text", row_key().alias("key")), None
    for b in range(blocks):
        items = [(r[0], r[1].encode()) for r in bench.filter(at == b).collect()]
        part = _pass(keyed, items, "hits").filter(F.size("hits") > 0).select("key", F.explode("hits").alias("hit"))
        found = part if found is None else found.unionByName(part)
    key, mine = fresh(docs, "key", "hits")
    per_doc = settle(found.distinct().groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list("hit")).alias(mine)), "hits")
    out = docs.withColumn(key, row_key()).join(per_doc, key, "left")
    return out.select(*columns(docs), F.coalesce(F.col(mine), F.array().cast(HITS)).alias(into))


def _leaks(threshold: float, hits: str = "_hits"):
    return F.filter(F.col(hits), lambda h: h["coverage"] >= threshold)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without contaminated ones, columns as they were."""
    (hits,) = fresh(docs, "_hits")
    return tiled(docs, benchmark, into=hits).filter(F.size(_leaks(threshold, hits)) == 0).select(*columns(docs))


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiled(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    leaks = _leaks(THRESHOLD)
    return found.select(
        "doc_id",
        F.transform(leaks, lambda h: h["item_id"]).alias("item_ids"),
        F.size(leaks).cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("_hits", lambda h: h["coverage"])), F.lit(0.0)).alias("coverage"),
        (F.size(leaks) > 0).cast("int").alias("contaminated"),
    )
