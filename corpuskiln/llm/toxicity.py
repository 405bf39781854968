"""Operator 8: toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words (lower-cased, outer punctuation gone) and
their openings of four characters, hashed to ``DIM`` ids; positions
and counts don't matter.  score = sigmoid(b + sum w_t + sum over pairs <v_s, v_t> / n):
the factor part learns that two terms together (an insult and a group mention)
mean more than each alone, which additive weights can't.  A term takes part if
it stands in ``LEAST`` training rows and the 2x2 table of term and label has a
chi-square of ``CHI``, or if it is half of a pair that says something else than
its halves (``interacting``); other terms would be learnt by heart.  Rows of the rarer label weigh more, by the root of the labels' ratio.

Training uses the labelled rows with crc32(doc_id) mod 3 not 1, rows equal in
id and text once, at most about ``TRAIN_ROWS`` of them, picked by row hash (a
documented bound: the model has a fixed size, and so has what the driver gathers).  AdaGrad over mini-batches in
a fixed order, so reruns agree.  Scoring is one narrow pass over all texts.

Defined cases: null and empty texts have no terms and score sigmoid(b); labels
that are null don't train; repeated labels of an id count once, the largest
one; without any usable label every score is 0.5 - nothing is predicted toxic;
extra columns are ignored; an empty table gives an empty result; a very long text
is read whole and counts by its distinct terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.llm.common import id_crc, in_batches, load, raw_texts, row_key, settle

DIM, RANK = 1 << 18, 8
TRAIN_ROWS, EPOCHS, STEPS, BATCH = 20_000, 12, 3000, 64
LEAST, CHI = 4, 12.0
#: Terms among which pairs are tested, rows that must hold a pair, and its chi-square.
PAIRED, PAIR_ROWS, PAIR_CHI = 2048, 8, 40.0
REJECT = 0.7
_EDGE = b" .,;:!?\"'()[]{}|<>*_-"


class Terms(dict):
    """word -> ids of its terms. The cache stays with a worker that goes on to other stages, so it is small."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 1 << 16:
            self.clear()
        bare = word.strip(_EDGE).decode("utf-8", "replace").lower()
        names = {f"w{bare}", f"a{bare[:4]}"} if bare else ()
        self[word] = found = tuple(xxhash.xxh32_intdigest(n.encode()) % DIM for n in names)
        return found


_TERMS = Terms()


def terms(text: bytes | None) -> np.ndarray:
    ids: set[int] = set()
    for found in map(_TERMS.__getitem__, set((text or b"").split())):
        ids.update(found)
    return np.sort(np.fromiter(ids, np.int32, len(ids)))


def associated(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which ids stand in enough documents and depend on the label, alone or together with another one."""
    both, pos = np.zeros(DIM), np.zeros(DIM)
    for k in range(0, len(docs), 1024):  # some documents at a time: the driver's memory is small
        part, toxic = docs[k : k + 1024], labels[k : k + 1024] > 0
        both += np.bincount(np.concatenate(part), minlength=DIM)
        pos += np.bincount(np.concatenate([d for d, t in zip(part, toxic) if t] or [part[0][:0]]), minlength=DIM)
    n, p = float(len(labels)), float(labels.sum())
    neg, off = both - pos, (p - pos, (n - p) - (both - pos))
    chi = n * (pos * off[1] - neg * off[0]) ** 2 / np.maximum(1e-9, p * (n - p) * both * (n - both))
    held = (both >= LEAST) & (chi >= CHI)
    held[interacting(docs, labels, both, pos)] = True
    return held


def interacting(docs: list[np.ndarray], labels: np.ndarray, both: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Ids of pairs whose label differs from what the two say one by one (their log-odds added up): an insult that
    needs a group mention, or two words that are harmless together only.  Among the ``PAIRED`` most frequent ids."""
    often = np.flatnonzero(both >= PAIR_ROWS)
    often = often[np.lexsort((often, -both[often]))][:PAIRED]
    at = np.full(DIM, -1)
    at[often] = np.arange(len(often))
    odds = lambda p: np.log(p / (1 - p))
    alone = odds((pos[often] + 0.5) / (both[often] + 1))
    base = odds(np.clip(labels.mean(), 0.01, 0.99))
    found = np.zeros(len(often), bool)
    for a in range(0, len(often), 256):  # some rows of the table of pairs at a time: the driver's memory is small
        n, hits = np.zeros((2, min(256, len(often) - a), len(often)), np.float32)
        for k in range(0, len(docs), 512):
            part, y = docs[k : k + 512], labels[k : k + 512].astype(np.float32)
            x = np.zeros((len(part), len(often)), np.float32)
            for i, d in enumerate(part):
                mine = at[d]
                x[i, mine[mine >= 0]] = 1
            own = x[:, a : a + 256].T
            n += own @ x
            hits += own @ (x * y[:, None])
        expect = np.clip(1 / (1 + np.exp(np.clip(base - alone[a : a + 256, None] - alone[None, :], -30, 30))), 0.01, 0.99)
        chi = (hits - n * expect) ** 2 / (n * expect * (1 - expect) + 1)
        chi[np.arange(len(n)), np.arange(a, a + len(n))] = 0
        found[a : a + 256] = ((n >= PAIR_ROWS) & (chi >= PAIR_CHI)).any(1)
    return often[found]


class Machine:
    def __init__(self):
        self.bias, self.w = 0.0, np.zeros(DIM, np.float32)
        self.v = np.zeros((DIM, RANK), np.float32)
        self.held = np.zeros(DIM, bool)  # terms that take part

    def raw(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid of documents laid end to end; their factor sums; 1/n."""
        full = sizes > 0
        lin, sums, squares = np.zeros(len(sizes)), np.zeros((len(sizes), RANK)), np.zeros(len(sizes))
        if full.any():
            v = self.v[ids]
            lin[full] = np.add.reduceat(self.w[ids].astype(np.float64), starts[full])
            sums[full] = np.add.reduceat(v, starts[full], axis=0)
            squares[full] = np.add.reduceat((v * v).sum(1), starts[full])
        share = 1.0 / np.maximum(1, sizes)
        return self.bias + lin + 0.5 * share * ((sums * sums).sum(1) - squares), sums, share

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, rate: float = 0.12, decay: float = 2e-5, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.v = (rng.standard_normal((DIM, RANK)) * 0.03).astype(np.float32)
        base = float(np.clip(labels.mean(), 0.01, 0.99))
        self.bias = float(np.log(base / (1 - base)))
        self.held = associated(docs, labels)
        docs = [d[self.held[d]] for d in docs]
        self.v[~self.held] = 0
        weight = np.where(labels > 0, np.sqrt((1 - base) / base), 1.0)
        gw, gv = np.full(DIM, 1e-1, np.float32), np.full((DIM, RANK), 1e-1, np.float32)
        for _ in range(max(EPOCHS, STEPS * BATCH // max(1, len(docs)))):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                sizes = np.array([len(docs[i]) for i in pick])
                ids = np.concatenate([docs[i] for i in pick])
                z, sums, share = self.raw(ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
                slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[pick]) * weight[pick]
                self.bias -= 0.02 * float(slope.mean())
                row = np.repeat(np.arange(len(pick)), sizes)
                each = slope[row].astype(np.float32)
                own, back = np.unique(ids, return_inverse=True)
                w_grad = np.bincount(back, each, len(own)) / len(pick) * 8 + decay * self.w[own]
                part = (each * share[row])[:, None] * (sums[row] - self.v[ids])
                v_grad = np.stack([np.bincount(back, part[:, k], len(own)) for k in range(RANK)], 1) / len(pick) * 8 + decay * self.v[own]
                gw[own] += w_grad**2
                gv[own] += v_grad**2
                self.w[own] -= rate * w_grad / np.sqrt(gw[own])
                self.v[own] -= 0.3 * rate * v_grad / np.sqrt(gv[own])

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        docs = [d[self.held[d]] for d in docs]
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if docs else sizes
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, starts, sizes)[0], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(id_crc() % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = docs.select("doc_id", "text").withColumn("key", row_key())
    rows = settle(keyed.select("doc_id", "key").join(usable, "doc_id").groupBy("key").agg(F.max("toxic").alias("toxic")), "training-rows")
    share = min(1.0, most / max(1, rows.count()))
    picked = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "toxic", "ids"])

    # about ``most`` rows at the largest
    chosen = keyed.join(F.broadcast(picked), "key").dropDuplicates(["key"]).select("doc_id", "text", "toxic")
    # written first and read partition by partition, so the driver's JVM never holds all of them
    ready = settle(in_batches(chosen, run, "doc_id long, toxic int, ids binary"), "training-terms")
    rows = sorted(((r["doc_id"], r["ids"], r["toxic"]) for r in ready.toLocalIterator()), key=lambda r: r[:2])
    machine = Machine()
    if rows:
        found, toxic = [np.frombuffer(ids, np.int32) for _, ids, _ in rows], np.array([float(t > 0) for *_, t in rows])
        del rows
        machine.fit(found, toxic)
    return machine


def score(docs: DataFrame, machine: Machine, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns, the score and the prediction (1 from 0.7 on). Columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in into])
    schema = T.StructType(list(kept.schema.fields)).add(into[0], T.DoubleType()).add(into[1], T.IntegerType())
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.score([terms(t) for t in raw_texts(batch.column(at))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= REJECT).astype(np.int32))], names=[*batch.schema.names, *into])

    return in_batches(kept, run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score", "predicted")
