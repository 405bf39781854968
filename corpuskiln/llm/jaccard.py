"""Operator 2: documents whose 5-word shingle sets have a Jaccard similarity of 0.8.

1. A fixed-size table counts, per slot of hashed shingles, the documents that
   have one.  It orders shingles from rare to frequent (ties by hash); any
   common order is right for prefix filtering, this one keeps shared passages
   out of prefixes.
2. Each document becomes a signature row: set hash, size, parity bitmap and the
   prefix of its ordered set.  Two sets that link share a prefix shingle.
   Equal sets are one class.
3. Prefix shingles of two or more classes form tiles, which are cut by size bands:
   rows without another one in their band or a neighbouring one drop out, as
   nothing they could link with is there; tiles of the same classes are one.  In a tile classes are taken in one of ``DRAWS`` hash orders; the first of each size band is a pivot, and a later class of compatible size is paired with it.  That is a
   pair per row, never all pairs of a tile.  The pairs are verified and joined
   to components.
4. What remains is completed exactly: only classes of a tile that are still in
   different components are compared, so no link between components is lost, and
   links inside one aren't needed.  A tile's largest component meets the others
   component by component, the others meet each other tile by tile, both in
   blocks of ``SIDE`` by ``SIDE`` classes, where bitmaps reject almost all pairs
   before they are rows.  A first turn takes each class's nearest partner of a
   block, which joins most; a second one takes every pair that is still open.
5. Verification: the bit count of two xor-ed parity bitmaps bounds the overlap
   from above; pairs that survive get an exact intersection of sorted arrays.
   A bitmap has at least two bits a member (up to ``MOST_BITS``), so the bound
   is sharp for long texts too; of two widths the wider one is folded.

Defined cases: null and empty texts have an empty set, link with nothing and
are their own component; texts of fewer than five words are one shingle; the
smallest non-null id names a component; repeated rows are copies of each
other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import WORD_NAMES, in_batches, load, mix, raw_texts, row_key, settings, settle, signed, spread, window_prints
from corpuskiln.llm.components import components

SIZE, PERCENT = 5, 80
SLOTS, BLOCK = 1 << 22, 1 << 14
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 14
#: Orders in which tiles draw pivots, and rows of one side of a comparison block.
DRAWS, SIDE = 12, 256
#: Rows of a tile up to which it is one row, held in memory.
TILE_ROWS = 4096
_U = np.uint64


def shingle_sets(texts: list[bytes | None], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct prints of the shingles of each text."""
    words = [(t or b"").lower().split() for t in texts]  # bytes.lower touches A-Z alone
    counts = np.array([len(w) for w in words], np.int64)
    names = WORD_NAMES.of(list(chain.from_iterable(words)))
    prints = window_prints(names, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(prints[at : at + n - size + 1]))
        else:
            out.append(window_prints(names[at : at + n], n) ^ _U(n) if n else np.zeros(0, _U))
        at += n
    return out


def frequencies(docs: DataFrame) -> np.ndarray:
    """Documents per slot, saturated at 65535: 8 MB whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            held += shingle_sets(raw_texts(batch.column("text")))
            if sum(map(len, held)) > 1_000_000:
                counts += np.bincount((np.concatenate(held) & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                held = []
        if held:
            counts += np.bincount((np.concatenate(held) & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = [(i, counts[i * BLOCK : (i + 1) * BLOCK]) for i in range(SLOTS // BLOCK)]
        some = [(i, np.minimum(c, 65535).astype(np.uint16).tobytes()) for i, c in some if c.any()]
        part = TaskContext.get().partitionId() // 256  # sums by parts, then over parts
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([c for _, c in some], pa.binary())], names=["block", "part", "counts"])

    def add(pdf):
        total = np.zeros(BLOCK, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint16)
        return pdf.iloc[:1].assign(counts=[np.minimum(total, 65535).astype(np.uint16).tobytes()])[["block", "part", "counts"]]

    schema = "block int, part int, counts binary"
    parts = in_batches(docs.select("text"), run, schema).groupBy("block", "part").applyInPandas(add, schema)
    table = np.zeros(SLOTS, np.uint16)
    for row in parts.groupBy("block").applyInPandas(add, schema).collect():
        table[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.uint16)
    return table


def bitmap(found: np.ndarray) -> bytes:
    """Parity bits: sets that differ in d members differ in at most d bits."""
    wide = max(LEAST_BITS, min(MOST_BITS, 1 << (2 * len(found) - 1).bit_length()))
    odd = np.bincount((mix(found) >> _U(40)).astype(np.int64) & (wide - 1), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of one width as rows of ``words`` 64-bit words; a wider one's halves are xor-ed."""
    t = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    while t.shape[1] > words:
        t = t[:, : t.shape[1] // 2] ^ t[:, t.shape[1] // 2 :]
    return t


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m members whose bitmaps differ so often can be similar enough."""
    return (100 + percent) * ((n + m - differ) // 2) >= percent * (n + m)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


SIGNATURE = "key long, doc_id long, n long, cls long, bits binary, prefix array<long>"


def signatures(docs: DataFrame, table: np.ndarray, percent: int) -> DataFrame:
    """A row per document; a class's later copies in a task carry no prefix, as the first one's does."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for found in shingle_sets(raw_texts(batch.column("text"))):
                n = len(found)
                if not n:
                    rows.append((0, None, None, None))
                    continue
                cls = int(signed(mix(np.bitwise_xor.reduce(mix(found), keepdims=True) + np.add.reduce(mix(found ^ _U(0x5851F42D4C957F2D)), keepdims=True) + _U(n)))[0])
                if cls in seen:
                    rows.append((n, cls, None, None))
                    continue
                seen.add(cls)
                often = sent.value[(found & _U(SLOTS - 1)).astype(np.int64)]
                order = np.argsort(often, kind="stable")  # found is sorted: ties go by hash
                rows.append((n, cls, bitmap(found), signed(found[order[: prefix_size(n, percent)]])))
            n, cls, bits, prefix = list(zip(*rows)) or [()] * 4
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, longs)], names=["key", "doc_id", "n", "cls", "bits", "prefix"])

    return in_batches(docs.select("key", "doc_id", "text"), run, SIGNATURE)


TILES = "tile long, members_print long, cls array<long>, n array<long>, pivot array<long>"


def tiles(signed_docs: DataFrame, percent: int) -> DataFrame:
    """(tile, cls, n, pivot): classes that share a prefix shingle; ``pivot`` is the class each is compared with first.

    Similar texts share many shingles, so tiles of the same classes are one tile. A tile of more than
    ``TILE_ROWS`` classes keeps its shingle as its name and comes in pieces."""
    rows = signed_docs.select("cls", "n", F.explode("prefix").alias("shingle"))
    most = TILE_ROWS
    # classes that can link are in one band or in neighbouring ones
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
    sorted_rows = rows.repartition(max(8, spread(signed_docs)), "shingle").sortWithinPartitions("shingle", band, F.xxhash64("cls", F.pmod("shingle", F.lit(DRAWS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, pivots, out = None, None, [], []
        held, pieces, first, band = [], 0, 0, 0  # rows of the tile, pieces of it that are out, its bands

        def close() -> None:
            nonlocal held, pieces
            if len(held) > 1 or held and pieces:
                c, k, p = zip(*held)
                members = int(np.bitwise_xor.reduce(mix(np.array(c, np.int64).view(_U))))
                name = int(signed(mix(np.array([members + len(c) & 2**64 - 1], _U)))[0])
                if pieces or len(held) >= most:
                    pieces += 1
                    piece = mix(np.array([now & 2**64 - 1], _U)) + _U((first << 32) + pieces)
                    out.append((now, int(signed(mix(piece))[0]), c, k, p))
                else:
                    out.append((name, name, c, k, p))
            held = []

        for batch in batches:
            shingle, cls, n = (batch.column(c).to_numpy() for c in ("shingle", "cls", "n"))
            if not len(shingle):
                continue
            bands = np.floor(np.log(n) / math.log(100 / percent) + 1e-9).astype(np.int64)
            near_next = (shingle[1:] == shingle[:-1]) & (bands[1:] - bands[:-1] <= 1)
            alone = ~(np.r_[False, near_next] | np.r_[near_next, False])
            alone[[0, -1]] = False  # the batches around may hold neighbours
            for i in np.flatnonzero(~alone).tolist():
                s, c, k, b = int(shingle[i]), int(cls[i]), int(n[i]), int(bands[i])
                if s != now or b - band > 1:
                    close()
                    now, last, first, band, pivots, pieces = s, c, b, b, [(c, k)], 0
                    held.append((c, k, None))
                    continue
                band = b
                if c == last:
                    continue
                last = c
                near = next((p for p, m in pivots if 100 * min(k, m) >= percent * max(k, m)), None)
                if near is None:
                    pivots.append((c, k))
                held.append((c, k, near))
                if len(held) >= most:
                    close()
            if len(out) > 2000:
                yield _tile_batch(out)
                out = []
        close()
        if out:
            yield _tile_batch(out)

    found = in_batches(sorted_rows.select("shingle", "cls", "n"), run, TILES).dropDuplicates(["members_print"])
    return found.select("tile", F.explode(F.arrays_zip("cls", "n", "pivot")).alias("m")).select("tile", "m.cls", "m.n", "m.pivot")


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    tile, members, *lists = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), pa.array(members, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["tile", "members_print", "cls", "n", "pivot"])


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted documents, settled. Where few are wanted, Spark's runtime filter (a Bloom
    filter of fixed size) drops other texts before the shuffle."""
    with settings(docs.sparkSession, **BLOOM):
        return settle(docs.select("key", "text").join(wanted.filter("n > 0").select("key"), "key").dropDuplicates(["key"]), "texts", after=(wanted,))


#: Settings under which the join for texts gets its runtime filter.
BLOOM = {"spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "1MB", "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "256MB"}
PAIRS = "a long, b long, ka long, kb long, na long"


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that sizes and bitmaps allow to link, with a document (key) of each."""
    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"), F.col("key").alias("ka"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"), F.col("key").alias("kb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("ba").to_pylist(), batch.column("bb").to_pylist()
            width = np.minimum([len(v) for v in x], [len(v) for v in y]) // 8
            differ = np.zeros(len(x), np.int64)
            for i, (u, v, w) in enumerate(zip(x, y, width.tolist())):
                differ[i] = np.bitwise_count(fold([u], w) ^ fold([v], w)).sum()
            keep = pa.array(may_link(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), differ, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "ka", "kb", "na")], names=["a", "b", "ka", "kb", "na"])

    return in_batches(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ka", "kb", "na", "nb", "ba", "bb"), run, PAIRS)


def verified(maybe: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link. ``maybe`` names a document of each (ka, kb) and a size."""
    maybe = settle(maybe, "maybe")
    wanted = maybe.select(F.col("ka").alias("key"), F.col("na").alias("n")).unionByName(maybe.select(F.col("kb").alias("key"), F.col("na").alias("n")))
    wanted = settle(wanted.groupBy("key").agg(F.max("n").alias("n")), "wanted")
    texts = texts_of(docs, wanted)
    both = maybe.join(texts.select(F.col("key").alias("ka"), F.col("text").alias("ta")), "ka").join(texts.select(F.col("key").alias("kb"), F.col("text").alias("tb")), "kb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(raw_texts(batch.column("ta"))), shingle_sets(raw_texts(batch.column("tb")))):
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return settle(in_batches(both.select("a", "b", "ta", "tb"), run, "a long, b long"), "links", after=(maybe, texts))


def distances(n: np.ndarray, bits: list[bytes], m: np.ndarray, others: list[bytes], percent: int) -> np.ndarray:
    """Differing bits of each row of one side and each of the other; -1 where they can't link."""
    out = np.full((len(n), len(m)), -1)
    here, there = np.array([len(x) for x in bits]), np.array([len(x) for x in others])
    for u in np.unique(here).tolist():
        for v in np.unique(there).tolist():
            i, j = np.flatnonzero(here == u), np.flatnonzero(there == v)
            x, y = n[i][:, None], m[j][None, :]
            fits = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            if not fits.any():
                continue
            words = min(u, v) // 8
            p, q = fold([bits[k] for k in i], words), fold([others[k] for k in j], words)
            differ = np.zeros(fits.shape, np.int64)
            for k in range(words):
                differ += np.bitwise_count(p[:, None, k] ^ q[None, :, k])
            out[np.ix_(i, j)] = np.where(fits & may_link(x, y, differ, percent), differ, -1)
    return out


def block_pairs(left: DataFrame, right: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b): classes of one ``grp``, one from each side and of different components, that may link.

    Each side of a group is cut into blocks by class hash; every pair of blocks
    is a task's small matrix, so a hot group is many of them.  ``nearest``: only
    the partner of a left class in the block whose bitmap is nearest."""
    count = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(float(SIDE))).cast("long").alias(name))
    blocks = settle(count(left, "ls").join(count(right, "rs"), "grp"), "blocks")
    bits = classes.select("cls", "bits")
    own = lambda size: F.pmod(F.xxhash64("cls", "grp"), F.col(size))
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1))
    lefts = left.join(blocks, "grp").join(bits, "cls").select("grp", own("ls").alias("i"), every("rs").alias("j"), F.lit(0).alias("side"), "cls", "n", "comp", "bits")
    rights = right.join(blocks, "grp").join(bits, "cls").select("grp", every("ls").alias("i"), own("rs").alias("j"), F.lit(1).alias("side"), "cls", "n", "comp", "bits")
    dealt = lefts.unionByName(rights).repartition(max(8, spread(left)), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side")
    names = ["grp", "i", "j", "side", "cls", "n", "comp"]

    def compare(t: np.ndarray, bits: list[bytes]) -> np.ndarray:
        at = int(np.searchsorted(t[:, 3], 1))
        x, y = t[:at], t[at:]
        if not len(x) or not len(y):
            return np.zeros((0, 2), np.int64)
        found = distances(x[:, 5], bits[:at], y[:, 5], bits[at:], percent)
        open_ = (found >= 0) & (x[:, 6][:, None] != y[:, 6][None, :])
        if nearest:
            i = np.flatnonzero(open_.any(1))
            j = np.where(open_, found, 1 << 40).argmin(1)[i]
        else:
            i, j = np.nonzero(open_)
        return np.stack([np.minimum(x[i, 4], y[j, 4]), np.maximum(x[i, 4], y[j, 4])], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = np.zeros((0, len(names)), np.int64), []
        for batch in batches:
            t = np.concatenate([rest, np.stack([batch.column(c).to_numpy() for c in names], 1)])
            held += batch.column("bits").to_pylist()
            cut = np.flatnonzero((t[1:, :3] != t[:-1, :3]).any(1)) + 1
            if len(cut):
                ends = cut.tolist()
                yield _pair_batch(np.concatenate([compare(t[b:e], held[b:e]) for b, e in zip([0, *ends], ends)]))
                t, held = t[ends[-1] :], held[ends[-1] :]
            rest = t
        if len(rest):
            yield _pair_batch(compare(rest, held))

    return in_batches(dealt.select(*names, "bits"), run, "a long, b long").distinct()


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def open_pairs(tile: DataFrame, part: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes that share a tile, stand in different components of ``part`` and may link, with a
    document of each; and the tiles that hold several components."""
    placed = tile.select("tile", "cls", "n").join(part, "cls")
    # what a tile's rows are joined with is settled: Spark then knows its size, and a small one costs no deal by tile
    split = settle(placed.groupBy("tile").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("tile"), "split")
    placed = settle(placed.join(split, "tile"), "split-tiles", after=(split,))
    weight = placed.groupBy("tile", "comp").agg(F.count("*").alias("w"))
    major = settle(weight.groupBy("tile").agg(F.max(F.struct("w", "comp"))["comp"].alias("major")), "major")
    minor = settle(placed.join(major, "tile").filter("comp != major"), "minor", after=(major,))
    several = minor.groupBy("tile").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("tile")
    in_tile = minor.join(several, "tile").select(F.col("tile").alias("grp"), "cls", "n", "comp")
    # groups of two kinds in one pass; should names of the two ever meet, pairs are compared in vain
    of_comp = lambda c: F.xxhash64(F.lit("component"), c).alias("grp")
    outward = minor.select(of_comp("major"), "cls", "n", "comp").distinct()
    members = part.join(minor.select(F.col("major").alias("comp")).distinct(), "comp").join(classes.select("cls", "n"), "cls").select(of_comp("comp"), "cls", "n", "comp")
    found = block_pairs(settle(in_tile.unionByName(outward), "left"), settle(in_tile.unionByName(members), "right"), classes, percent, nearest)
    key = lambda x: classes.select(F.col("cls").alias(x), F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"))
    return found.join(key("a"), "a").join(key("b").drop("nb"), "b").select("a", "b", "ka", "kb", "na"), placed.drop("comp")


def similar(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, n_shingles, cls, comp, component_id) per document; comp tells components apart whose
    least ids agree or are all null."""
    keyed = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = settle(signatures(keyed, frequencies(docs), percent), "signatures")
    tile = settle(tiles(sets.filter("prefix IS NOT NULL"), percent), "tiles")
    shared = settle(tile.select("cls").distinct(), "shared")
    # the first document of each class that shares anything
    firsts = sets.filter("bits IS NOT NULL").join(shared, "cls").groupBy("cls").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    firsts = settle(firsts, "classes")

    stars = tile.filter("pivot IS NOT NULL").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    comp = components(verified(bounded(stars, firsts, percent), keyed, percent))
    part = settle(shared.join(comp, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("comp", "cls").alias("comp")), "components")
    for nearest in (True, False):  # tiles whose classes are in different components, completed
        pairs, tile = open_pairs(tile, part, firsts, percent, nearest)
        more = verified(pairs, keyed, percent)
        lifted = more.join(part.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a").join(part.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b")
        merged = components(lifted.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        part = settle(part.join(merged, part["comp"] == merged["node"], "left").select("cls", F.coalesce(merged["comp"], part["comp"]).alias("comp")), "components")

    least = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = settle(least.join(part, "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp")), "named")
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "comp").select("cls", "comp", "component_id")
    return sets.select("key", "doc_id", F.col("n").alias("n_shingles"), "cls").join(of_class, "cls", "left").select("key", "doc_id", "n_shingles", "cls", "comp", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM docs)),
sets AS (SELECT DISTINCT doc_id, s FROM sh),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
same AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM same JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, b FROM reach JOIN links ON seen = a)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON documents.doc_id = r.node
"""
