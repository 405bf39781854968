"""Operator 1: substring dedup by recompression.

A word sequence is rewritten in rounds.  A round names runs of one symbol
(symbol, length) and then pairs of adjacent symbols (left, right) whose left
one is of the round's left class and whose right one is of its right class.
Names are 64-bit hashes of what they stand for, so they are global: any task
gives equal parts equal names and no round has to agree with another task.

Each symbol carries its *context*: the words that decided that it exists.
Equal word sequences have equal interior symbols, namely those whose context
lies inside; so for a window of ``width`` words the highest level with such a
symbol, and on it the one with the largest scrambled name, depend on the
window's words alone.  That symbol is the window's anchor.  Consecutive windows
with one anchor are one row: (context name, print of all their words, place) -
a row per dozen words or so instead of one per word.

Spark then decides in three joins:
1. context names that occur once belong to no repeat and drop out;
2. rows that agree in name and in all their words are repeats throughout;
3. of names whose rows differ, one row per wording is opened into its windows,
   and windows are compared by (name, print).
A hot passage is pre-aggregated before each shuffle, and the joins back to the
places are plain equi-joins that adaptive execution splits when skewed.

Defined cases: null and empty texts have no words, keep '' and remove nothing;
texts of fewer than ``width`` words keep all; overlapping occurrences in one
document count (periodic text); each row is a document, so a repeated row of at
least ``width`` words loses all words in both rows; extra columns are ignored;
an empty table gives an empty result.  A very long text is one task's: its words
and names take some 40 bytes a word there, and nothing of it is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import WORD_NAMES, in_batches, inverse, load, mix, powers, raw_texts, row_key, settle, signed

WIDTH, ROUNDS = 35, 3
#: Words of one piece of work inside a task.
PIECE = 400_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
#: The largest index of a symbol in a piece; a text of Spark is too short to have more.
_LAST = _U((1 << 32) - 1)


class Level:
    """Symbols over words: ``name``, words ``start``..``end``-1, context ``lo``..``hi``, and document."""

    def __init__(self, name, start, lo, hi, doc):
        self.name, self.start, self.lo, self.hi, self.doc = name, start, lo, hi, doc

    def sides(self, first: np.ndarray, last: np.ndarray):
        """Contexts widened to the neighbours'; past a document's edge they leave the document."""
        n = len(self.name)
        before = np.r_[True, self.doc[1:] != self.doc[:-1]]
        after = np.r_[self.doc[1:] != self.doc[:-1], True]
        left = np.where(before, first[self.doc] - 1, self.lo[np.maximum(np.arange(n) - 1, 0)])
        right = np.where(after, last[self.doc] + 1, self.hi[np.minimum(np.arange(n) + 1, n - 1)])
        return before, after, np.minimum(left, self.lo), np.maximum(right, self.hi)


def _runs(x: Level, first: np.ndarray, last: np.ndarray) -> Level:
    before, _, left, right = x.sides(first, last)
    head = np.flatnonzero(before | np.r_[True, x.name[1:] != x.name[:-1]])
    tail = np.r_[head[1:], len(x.name)] - 1
    size = (tail - head + 1).astype(_U)
    name = np.where(size > 1, mix(x.name[head] * _U(0xA24BAED4963EE407) + size), x.name[head])
    return Level(name, x.start[head], left[head], right[tail], x.doc[head])


def _pairs(x: Level, turn: int, first: np.ndarray, last: np.ndarray) -> Level:
    _, after, left, right = x.sides(first, last)
    is_left = (mix(x.name + _U(0x9FB21C651E98DF25 * (turn + 1) & (2**64 - 1))) & _U(1)).astype(bool)
    joined = is_left & ~after & ~np.r_[is_left[1:], True]
    second = np.r_[False, joined[:-1]]
    lo, hi = np.where(is_left, x.lo, left), np.where(is_left, right, x.hi)
    # a joined pair exists because both parts do; nothing else had a say
    at = np.flatnonzero(joined)
    lo[at], hi[at] = np.minimum(x.lo[at], x.lo[at + 1]), np.maximum(x.hi[at], x.hi[at + 1])
    name = x.name.copy()
    name[at] = mix(x.name[at] * _U(0xE7037ED1A0B428DB) + mix(x.name[at + 1] + _U(turn + 1)))
    keep = ~second
    return Level(name[keep], x.start[keep], lo[keep], hi[keep], x.doc[keep])


def recompress(names: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """All levels, words first."""
    at = np.arange(len(names))
    levels = [Level(names, at, at, at, doc)]
    for turn in range(rounds):
        levels.append(_pairs(_runs(levels[-1], first, last), turn, first, last))
    return levels


class Prints:
    """Prints of any range of words."""

    def __init__(self, names: np.ndarray):
        self.sums = np.zeros(len(names) + 1, _U)
        np.cumsum(names * powers(len(names), _BASE), out=self.sums[1:])
        self.back = powers(len(names), inverse(_BASE))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi + 1] - self.sums[lo]) * self.back[lo])


def _best(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximum of key over index ranges lo..hi (none empty)."""
    span = hi - lo + 1
    out, table, size = np.zeros(len(lo), _U), key, 1
    most = int(span.max()) if len(span) else 0
    while True:
        mine = (span >= size) & (span < 2 * size)
        out[mine] = np.maximum(table[lo[mine]], table[hi[mine] - size + 1])
        if 2 * size > most:
            return out
        table = np.maximum(table[:-size], table[size:]) if len(table) > size else table
        size *= 2


def anchors(names: np.ndarray, lengths: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS):
    """Rows of a piece of documents laid end to end: (document, first window, last window, context name, wording)."""
    n = len(names)
    last = np.cumsum(lengths) - 1
    first = last - lengths + 1
    doc = np.repeat(np.arange(len(lengths)), lengths)
    window = np.flatnonzero(np.arange(n) + width - 1 <= last[doc]) if n else np.zeros(0, np.int64)
    if not len(window):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    levels = recompress(names, doc, first, last, rounds)
    pick, picked_level = np.zeros(len(window), np.int64), np.full(len(window), -1)
    bits = _U(32)  # one width for all pieces, or equal windows could pick different symbols
    for depth in range(len(levels) - 1, -1, -1):
        open_ = np.flatnonzero(picked_level < 0)
        if not len(open_):
            break
        x, p = levels[depth], window[open_]
        i0, i1 = np.searchsorted(x.lo, p, "left"), np.searchsorted(x.hi, p + width - 1, "right") - 1
        some = i0 <= i1
        if not some.any():
            continue
        index = np.arange(len(x.name), dtype=_U)
        key = (mix(x.name) >> bits << bits) | (_LAST - index)
        best = _best(key, i0[some], i1[some])
        pick[open_[some]] = (_LAST - (best & _LAST)).astype(np.int64)
        picked_level[open_[some]] = depth
    cut = np.r_[True, (np.diff(window) != 1) | (np.diff(pick) != 0) | (np.diff(picked_level) != 0)]
    head = np.flatnonzero(cut)
    tail = np.r_[head[1:], len(window)] - 1
    a, b, lvl, sym = window[head], window[tail], picked_level[head], pick[head]
    lo, hi = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
    for depth, x in enumerate(levels):
        mine = lvl == depth
        lo[mine], hi[mine] = x.lo[sym[mine]], x.hi[sym[mine]]
    prints = Prints(names)
    name = mix(prints(lo, hi) + ((hi - lo) * 8 + lvl).astype(_U) * _U(0x8EBC6AF09C88C6E3))
    wording = mix(prints(a, b + width - 1) + ((lo - a) * 4096 + (b - a)).astype(_U) * _U(0x589965CC75374CC3))
    return doc[a], a - first[doc[a]], b - first[doc[a]], name, wording


def names_of(text: bytes | None) -> np.ndarray:
    return WORD_NAMES.of((text or b"").split())


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Names of consecutive texts, about PIECE words at a time: (first text, names, lengths)."""
    at, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(names_of(text))
        total += len(held[-1])
        if total >= PIECE or i == len(texts) - 1:
            yield at, np.concatenate(held), np.array([len(x) for x in held])
            at, held, total = i + 1, [], 0


ROWS = "name long, wording long, key long, a int, b int"


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for at, names, lengths in _pieces(raw_texts(batch.column("text"))):
                doc, a, b, name, wording = anchors(names, lengths, width)
                yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(signed(wording)), pa.array(keys[doc + at]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["name", "wording", "key", "a", "b"])

    return in_batches(docs.select("key", "text"), run, ROWS)


def window_rows(docs: DataFrame, opened: DataFrame, width: int) -> DataFrame:
    """(name, print, key, p, alone) of each window of the opened rows."""
    asked = opened.groupBy("key").agg(F.collect_list(F.struct("name", "a", "b", "alone")).alias("rows"))
    joined = docs.select("key", "text").join(asked, "key").select("key", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, rows in zip(batch.column("key").to_pylist(), raw_texts(batch.column("text")), batch.column("rows")):
                flat = rows.values.flatten()
                name, a, b, alone = (x.to_numpy(zero_copy_only=False) for x in flat)
                prints = Prints(names_of(text))
                size = b - a + 1
                row = np.repeat(np.arange(len(a)), size)
                p = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + a[row]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name[row]), pa.array(signed(prints(p, p + width - 1))), pa.array(np.full(len(p), key, np.int64)), pa.array(p.astype(np.int32)), pa.array(alone[row])], names=["name", "print", "key", "p", "alone"])

    return in_batches(joined, run, "name long, print long, key long, p int, alone boolean")


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, a, b): windows a..b of a document that start a repeated sequence. ``docs`` has key, text."""
    rows = settle(anchor_rows(docs, width), "anchors")  # used twice, and the dearest step
    # tables are settled before a join on hot keys: a side that ends in an aggregation can't be split
    shared = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("wording").alias("w0"), F.max("wording").alias("w1")).filter("n > 1")
    shared = settle(shared.select("name", (F.col("w0") != F.col("w1")).alias("mixed")), "names")
    found = settle(rows.join(shared, "name"), "shared-names", after=(rows, shared))
    whole = found.filter("NOT mixed").select("key", "a", "b")
    mixed = found.filter("mixed")
    wordings = mixed.groupBy("name", "wording").agg(F.count("*").alias("n"), F.min(F.struct("key", "a", "b")).alias("one"))
    wordings = settle(wordings, "wordings")
    again = mixed.join(wordings.filter("n > 1").select("name", "wording"), ["name", "wording"]).select("key", "a", "b")
    opened = wordings.select("name", "one.key", "one.a", "one.b", (F.col("n") == 1).alias("alone"))
    windows = settle(window_rows(docs, opened, width), "windows")
    twice = windows.groupBy("name", "print").agg(F.count("*").alias("n")).filter("n > 1").select("name", "print")
    twice = settle(twice, "prints")
    single = windows.filter("alone").join(twice, ["name", "print"]).select("key", F.col("p").alias("a"), F.col("p").alias("b"))
    return whole.unionByName(again).unionByName(single)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:int,end:int>>"


def dedup_substrings(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """Per document: words, removed words, hash of the kept words, the kept words and the
    removed word ranges (both null unless ``keep_text``)."""
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    found = repeats(keyed, width).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(found, "key", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(raw_texts(batch.column("text")), batch.column("spans")):
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid:
                    a, b = (x.to_numpy() for x in spans.values.flatten())
                    np.add.at(gone, a, 1)
                    np.add.at(gone, np.minimum(b + width, len(words)), -1)
                gone = np.cumsum(gone[:-1]) > 0 if len(words) else np.zeros(0, bool)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))) if keep_text else None
                ranges = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])] if keep_text else None
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None, ranges))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"])

    return in_batches(joined, run, SCHEMA)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(load(spark, sf_dir, "documents"), keep_text=False).drop("kept_text", "removed")


OP1_SQL = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT k, p, md5(array_to_string(list_slice(ws, p, p + {WIDTH - 1}), ' ')) AS h2
  FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - {WIDTH - 1})) AS p FROM docs WHERE len(ws) >= {WIDTH})),
again AS (SELECT h2 FROM windows GROUP BY h2 HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT k, unnest(generate_series(p, p + {WIDTH - 1})) AS i FROM windows JOIN again USING (h2)),
words AS (SELECT k, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM docs),
judged AS (SELECT words.k, words.i, w, gone.k IS NOT NULL AS g FROM words LEFT JOIN gone ON words.k = gone.k AND words.i = gone.i)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN (
  SELECT k, count(*) FILTER (g) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT g) AS kept FROM judged GROUP BY k) j USING (k)
"""
