"""Operator 6: language-model scores of whole documents.

1. Counts: every word of the training documents (crc32(doc_id) mod 7 not 2),
   plus one end token per document, combined in the task and summed by 64-bit
   word name.  This covers the whole training corpus and grows with it.
2. Head and tail: the words counted at least 2**k times, k being the least for
   which there are at most ``HEAD`` of them, are broadcast (a bounded table);
   all other words meet their counts in a join, by name.  Tail words are rare
   by construction, so no key is hot.
3. Training: documents, as 16-bit word ids, are dealt to rounds and tasks by row
   hash.  In each round every task trains the gated recurrent model (see ``gru``)
   on its documents from common weights, and the weights are averaged by words
   seen, in one order; the next round goes on from there at a smaller rate.  The
   number of rounds grows with the corpus, so more text makes a better model.
   Neither the layout of the input nor a lost executor changes it.  Step sizes
   depend on how much text a task has: a short rest trains in fewer lanes.
4. Scoring: one pass; documents of a task advance together with their states
   carried from window to window.  Words outside the model's vocabulary are
   its class "rare", within which they have their add-one unigram share.

Defined cases: null and empty texts are the end token alone; a null id counts
as crc 0 and trains; rows that agree in id and text have equal scores; without
any training document N is 0, every base probability is 1/(V+1) with V = 0;
extra columns are ignored; an empty table gives an empty result; a very long
text is scored whole, window by window, with its state carried on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import Names, id_crc, in_batches, load, mix, raw_texts, release, row_key, settle, signed
from corpuskiln.llm.gru import SPAN, Gru, Trainer

HEAD, VOCABULARY = 1 << 19, 2048
#: Words a task holds while it trains, and the sequences that train together.
TAUGHT, LANES = 2_000_000, 256
#: Rounds are the square root of the corpus in units of so many words, at most so many.
ROUND_WORDS, MOST_ROUNDS = 1_000_000, 64
#: Tasks among which training documents are dealt; beyond so many a task trains longer.
MOST_TASKS = 1 << 16
#: Documents that advance together in a task.
TOGETHER = 4096
BLOCK = 1 << 12
_END_WORD = b" end"  # no word has a space
END = int(Names()[_END_WORD])
_U = np.uint64


def tokens(text: bytes | None) -> list[bytes]:
    """The words, A-Z lower-cased, without the end."""
    return (text or b"").lower().split()  # bytes.lower touches A-Z alone


def counts(training: DataFrame) -> DataFrame:
    """(name, c) of all tokens of the texts."""

    def flush(held: Counter) -> pa.RecordBatch:
        name = np.fromiter(map(xxhash.xxh3_64_intdigest, held), _U, len(held))
        return pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["name", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            held[_END_WORD] += len(texts)
            for text in texts:
                held.update(tokens(text))
            if len(held) > 400_000:
                yield flush(held)
                held.clear()
        if held:
            yield flush(held)

    return in_batches(training.select("text"), run, "name long, c long").groupBy("name").agg(F.sum("c").alias("c"))


class Head:
    """The broadcast words: sorted names, their counts, and each one's word id in the model (or -1)."""

    def __init__(self, names: np.ndarray, c: np.ndarray, vocabulary: int):
        best = np.lexsort((names, -c))[: vocabulary - 1]
        words = list(best)
        end = np.flatnonzero(names == _U(END))
        if len(end) and end[0] not in set(words):
            words = words[:-1] + [int(end[0])]
        order = np.argsort(names)
        self.names, self.c = names[order], c[order]
        at = {int(i): w for w, i in enumerate(words)}
        self.word = np.array([at.get(int(i), -1) for i in order], np.int32)
        self.size = len(words)
        self.word_counts = c[np.array(words, np.int64)] if words else np.zeros(0, np.int64)


class Places(dict):
    """word -> its place in the head, or -1 - its place in ``tail``, a list of names."""

    def __init__(self, head: Head):
        super().__init__()
        self.head = dict(zip(head.names.tolist(), range(len(head.names))))
        self.tail: list[int] = []

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_64_intdigest(word)
        at = self.head.get(name)
        if at is None:
            self.tail.append(name)
            at = -len(self.tail)
        self[word] = at
        return at

    def of(self, text: bytes | None) -> np.ndarray:
        words = tokens(text)
        words.append(_END_WORD)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def renew(self) -> None:
        """Forgets words when there are too many; earlier places of tail words are void then."""
        if len(self) > 600_000:
            self.clear()
            self.tail = []


def _totals(table: DataFrame) -> tuple[int, int, int]:
    """N, V and the least count of a head word."""
    steps = [F.coalesce(F.sum((F.col("c") >= 1 << k).cast("long")), F.lit(0)).alias(f"k{k}") for k in range(50)]
    row = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), *steps).first()
    return row["n"], row["v"], next(1 << k for k in range(50) if row[f"k{k}"] <= HEAD or k == 49)


def _word_ids(head: Head, at: np.ndarray) -> np.ndarray:
    word = np.where(at >= 0, head.word[np.maximum(at, 0)] if len(head.word) else -1, -1)
    return np.where(word >= 0, word, head.size)


class Ids(dict):
    """word -> its id in the model, that of "rare" for all others."""

    def __init__(self, head: Head):
        super().__init__()
        held = np.flatnonzero(head.word >= 0)
        self.head, self.rare = dict(zip(head.names[held].tolist(), head.word[held].tolist())), head.size

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        self[word] = found = self.head.get(xxhash.xxh3_64_intdigest(word), self.rare)
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        words = tokens(text)
        words.append(_END_WORD)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def dealt(training: DataFrame, head: Head) -> DataFrame:
    """(deal, ids): the training documents as word ids, dealt to tasks by row hash and not by input split.

    Rows that agree in id and text are told apart by their number in the split, so many of them are many deals."""
    sent = training.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = Ids(sent.value), Counter()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            nth = np.array([seen[k] for k in keys if seen.update((k,)) is None], _U)
            if len(seen) > 1_000_000:
                seen = Counter({k: c for k, c in seen.items() if c > 1})
            deal = mix(np.array(keys, np.int64).view(_U) + nth * _U(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(signed(deal)), pa.array([ids.of(t).astype(np.uint16).tobytes() for t in raw_texts(batch.column("text"))], pa.binary())], names=["deal", "ids"])

    return in_batches(training.select("key", "text"), run, "deal long, ids binary")


def rounds_of(tokens: int) -> int:
    """Rounds of training: their number grows with the corpus, as the square root of its words."""
    return max(1, min(MOST_ROUNDS, math.isqrt(tokens // ROUND_WORDS)))


def train(training: DataFrame, head: Head, model: Gru, tokens: int = 0, rounds: int | None = None) -> Gru:
    """The model, trained on (key, text). ``tokens`` of the training documents decide among how many rounds and
    tasks they are dealt, so another layout of the input trains the same model."""
    rounds = rounds or rounds_of(tokens)
    tasks = max(1, min(MOST_TASKS, -(-tokens // (rounds * TAUGHT))))
    spoken = dealt(training, head)
    if rounds > 1:  # a round reads its own folder
        spoken = settle(spoken.withColumn("round", F.pmod(F.shiftright("deal", 20), F.lit(rounds)).cast("int")), "dealt", by=("round",))
    for r in range(rounds):
        part = spoken.filter(F.col("round") == r).drop("round") if rounds > 1 else spoken
        _trained(part.repartition(tasks, "deal").sortWithinPartitions("deal"), head, model, 1 - r / rounds)
    if rounds > 1:
        release(spoken)
    return model


def _trained(spoken: DataFrame, head: Head, model: Gru, share: float) -> None:
    """One round: every task goes on from ``model`` with its documents, at this share of the full rate; the model becomes
    the average of theirs."""
    sent = spoken.sparkSession.sparkContext.broadcast((head, model.pack()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, start = sent.value
        mine = Gru(head.word_counts, 1.0)
        mine.unpack(start)
        trainer = Trainer(mine)
        docs, size, seen, rate, blocks = [], 0, 0, trainer.full * share, 0
        trainer.full = rate
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                docs.append(np.frombuffer(ids, np.uint16).astype(np.int32))
                size += len(docs[-1])
                if size >= TAUGHT:
                    seen += trainer.fit(docs, LANES)
                    docs, size, blocks = [], 0, blocks + 1
                    trainer.full = rate / math.sqrt(1 + blocks)
        seen += trainer.fit(docs, LANES if size > LANES * LANES * SPAN else 64)  # a short rest takes smaller steps
        if not seen:
            return
        flat = mine.pack() * seen
        parts = [flat[i : i + BLOCK].astype(np.float64).tobytes() for i in range(0, len(flat), BLOCK)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task % 64] * len(parts), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())], names=["block", "part", "task", "seen", "weights"])

    def add(pdf):
        pdf = pdf.sort_values(["part", "task"])  # one order of sums
        total = sum(np.frombuffer(w, np.float64) for w in pdf["weights"])
        return pdf.iloc[:1].assign(seen=pdf["seen"].sum(), weights=[total.tobytes()])[["block", "part", "task", "seen", "weights"]]

    schema = "block int, part int, task int, seen double, weights binary"
    summed = in_batches(spoken, run, schema).groupBy("block", "part").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    rows = sorted(summed.collect(), key=lambda r: r["block"])  # the size of the model
    if rows:
        model.unpack(np.concatenate([np.frombuffer(r["weights"], np.float64) / r["seen"] for r in rows]))


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, rare_log double, n_rare long, model_ln double, tail array<struct<name:long,tf:int>>"


def _passes(docs: DataFrame, head: Head, model: Gru) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((head, model))

    def flush(held, places):
        head, model = sent.value
        keys, ids, outs, codes = zip(*held)
        sizes = np.array([len(x) for x in codes])
        at = np.concatenate(codes)
        tail_names = np.array(places.tail, _U)
        words = _word_ids(head, at)
        doc = np.repeat(np.arange(len(held)), sizes)
        known = at >= 0
        logs = np.where(known, np.log10((head.c[np.maximum(at, 0)] if len(head.c) else np.zeros(len(at))) + 1.0), 0.0)
        rare = words == head.size
        edges = np.cumsum(sizes)[:-1]
        model_ln = model.score(np.split(words, edges))
        tails = np.flatnonzero(~known)
        tail_lists: list[list[dict]] = [[] for _ in held]
        if len(tails):
            d, t = doc[tails], tail_names[-1 - at[tails]]
            order = np.lexsort((t, d))
            d, t = d[order], t[order]
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
            for k, name, tf in zip(d[first].tolist(), signed(t[first]).tolist(), np.diff(np.r_[first, len(d)]).tolist()):
                tail_lists[k].append({"name": name, "tf": tf})
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(outs, pa.bool_()), pa.array(sizes), pa.array(np.bincount(doc, known, n).astype(np.int64)), pa.array(np.bincount(doc, logs, n)), pa.array(np.bincount(doc, logs * rare, n)), pa.array(np.bincount(doc, rare, n).astype(np.int64)), pa.array(model_ln), pa.array(tail_lists, pa.list_(pa.struct([("name", pa.int64()), ("tf", pa.int32())])))],
            names=["key", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "rare_log", "n_rare", "model_ln", "tail"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, places = [], 0, Places(sent.value[0])
        for batch in batches:
            for key, doc_id, out, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), raw_texts(batch.column("text"))):
                held.append((key, doc_id, out, places.of(text)))
                size += len(held[-1][3])
                if len(held) >= TOGETHER or size > 3_000_000:
                    yield flush(held, places)
                    held, size = [], 0
                    places.renew()
        if held:
            yield flush(held, places)

    return in_batches(docs, run, SCORED)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    keyed = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), (id_crc() % 7 == 2).alias("held_out"), "text")
    training = docs.select("doc_id", "text").filter(id_crc() % 7 != 2)
    table = settle(counts(training), "counts")
    n, v, least = _totals(table)
    top = table.filter(F.col("c") >= least).toArrow()  # HEAD rows at most
    head = Head(top["name"].to_numpy().view(_U), top["c"].to_numpy(), VOCABULARY)
    rare_n, rare_v = n - int(head.word_counts.sum()), v - head.size
    model = train(keyed.filter("NOT held_out"), head, Gru(head.word_counts, float(rare_n)), n)
    scored = settle(_passes(keyed, head, model), "scored")

    log_base, log_rare = math.log10(n + v + 1), math.log10(rare_n + rare_v + 1)
    tail = scored.select("key", F.explode("tail").alias("t")).select("key", F.col("t.name").alias("name"), F.col("t.tf").alias("tf"))
    met = tail.join(table.filter(F.col("c") < least), "name")  # unseen words add log10(0 + 1) = 0
    sums = met.select("key", (F.col("tf") * F.log10(F.col("c") + 1.0)).alias("log"), F.col("tf").alias("known"))
    sums = sums.groupBy("key").agg(F.sum("log").alias("tail_log"), F.sum("known").alias("tail_known"))
    copies = scored.groupBy("key").agg(F.count("*").alias("copies"))  # equal rows have added up
    sums = sums.join(copies, "key").select("key", (F.col("tail_log") / F.col("copies")).alias("tail_log"), (F.col("tail_known") / F.col("copies")).cast("long").alias("tail_known"))
    out = scored.drop("tail").join(sums, "key", "left").fillna(0, ["tail_log", "tail_known"])
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.col("tail_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * F.lit(log_base)).alias("base_score"),
        (F.col("model_ln") / math.log(10) + F.col("rare_log") + F.col("tail_log") - F.col("n_rare") * F.lit(log_rare)).alias("score"),
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))
