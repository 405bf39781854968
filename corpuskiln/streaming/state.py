"""Keyed state of streams: conversations, the answer cache, and which cached answers a document stands behind.

Each is a ``StatefulProcessor`` behind ``transformWithStateInPandas``: state lies in RocksDB
on the executors, is checkpointed by Spark, and comes back after a restart.  A key's state
is bounded: the newest messages, the last documents, one answer, the keys of one document.

* ``conversations``: ListState of the newest ``MESSAGES`` messages by id and the last ``DOCUMENTS`` documents.
* ``answer_cache``: ValueState of an answer with the event time at which it expires; a timer removes it, and what is
  asked at or behind that time misses even if the timer has not run yet.  State that no row touches
  any more is dropped by its time to live as well.
* ``invalidations``: MapState of cache keys by document; a changed document gives its keys out to be dropped.

Defined cases: rows of a batch are taken in order of their time, ties by what they are; a message that came before is
counted once; a message older than the kept ones changes nothing; rows behind the watermark
are dropped by Spark; a put of a key replaces its answer and its expiry; unknown kinds of rows are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGES, DOCUMENTS, TTL_MS = 100, 5, 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    """State of this kind needs Spark's RocksDB store; a session that names another one is left to say so itself."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one batch, by time."""
    parts = [p for p in rows if len(p)]
    return pd.concat(parts).sort_values(list(by), kind="stable") if parts else pd.DataFrame(columns=list(by))


class _Conversation(StatefulProcessor):
    def __init__(self, messages: int, documents: int):
        self.most, self.last = messages, documents

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "message_id long, text string")
        self.documents = handle.getListState("documents", "document string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = {int(m[0]): m[1] for m in self.messages.get()} if self.messages.exists() else {}
        seen = [d[0] for d in self.documents.get()] if self.documents.exists() else []
        for row in _in_order(rows, "at", "message_id").itertuples():
            if row.kind == "message":
                kept[int(row.message_id)] = row.text
            elif row.kind == "document":
                seen.append(row.text)
        kept, seen = dict(sorted(kept.items())[-self.most :]), seen[-self.last :]
        if kept:
            self.messages.put([(i, t) for i, t in kept.items()])
        if seen:
            self.documents.put([(d,) for d in seen])
        yield pd.DataFrame({"conversation_id": [key[0]], "n_kept": [len(kept)], "oldest": [min(kept, default=None)], "documents": [seen]}).astype({"oldest": "Int64"})

    def close(self) -> None:
        pass


def conversations(events: DataFrame, messages: int = MESSAGES, documents: int = DOCUMENTS) -> DataFrame:
    """(conversation_id, n_kept, oldest, documents) after each batch that touches a conversation. ``events``:
    conversation_id, kind (message or document), message_id, text (the message's or the document's name), at."""
    prepared(events.sparkSession)
    return events.groupBy("conversation_id").transformWithStateInPandas(
        _Conversation(messages, documents), "conversation_id long, n_kept long, oldest long, documents array<string>", "Update", "None")


class _Cache(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "answer string, expires long")

    def _clear(self) -> None:
        if self.entry.exists():
            self.handle.deleteTimer(int(self.entry.get()[1]))
            self.entry.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in _in_order(rows, "at", "kind").itertuples():
            at = int(row.at.timestamp() * 1000)
            if row.kind == "put":
                self._clear()
                self.entry.update((row.answer, at + self.ttl))
                self.handle.registerTimer(at + self.ttl)
            elif row.kind == "drop":
                self._clear()
            elif row.kind == "get":
                held = self.entry.get() if self.entry.exists() else None
                hit = held is not None and at < held[1]
                out.append((key[0], row.at, "hit" if hit else "miss", held[0] if hit else None))
        yield pd.DataFrame(out, columns=["key", "at", "result", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        held = self.entry.get() if self.entry.exists() else None
        out = []
        if held is not None and held[1] <= expired:
            self.entry.clear()
            out.append((key[0], pd.Timestamp(expired, unit="ms"), "expired", None))
        yield pd.DataFrame(out, columns=["key", "at", "result", "answer"])

    def close(self) -> None:
        pass


def answer_cache(events: DataFrame, ttl_ms: int = TTL_MS, late: str = "10 minutes") -> DataFrame:
    """(key, at, result, answer): a row for each question (hit or miss) and each answer that expired. ``events``: key, kind
    (put, get or drop), answer, at; event time decides, and rows later than ``late`` are dropped."""
    prepared(events.sparkSession)
    return events.withWatermark("at", late).groupBy("key").transformWithStateInPandas(
        _Cache(ttl_ms), "key string, at timestamp, result string, answer string", "Append", "EventTime")


class _Sources(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "key string", "at long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gone = []
        for row in _in_order(rows, "at", "kind").itertuples():
            if row.kind == "source":
                self.keys.updateValue((row.key,), (int(row.at.timestamp() * 1000),))
            elif row.kind == "changed" and self.keys.exists():
                gone += [(k[0], "drop", None, row.at) for k in self.keys.keys()]
                self.keys.clear()
        yield pd.DataFrame(sorted(gone, key=lambda r: (r[3], r[0])), columns=["key", "kind", "answer", "at"])

    def close(self) -> None:
        pass


def invalidations(events: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """(key, kind = drop, answer, at): rows for ``answer_cache``, one for each cached answer that a changed document stood behind.
    ``events``: document_id, kind (source or changed), key, at. A key that nobody asks about is forgotten after ``ttl_ms``
    of the executors' clock, as the answer itself is by then; Spark then looks for such keys in batches without rows, so a
    trigger that ends when all is read doesn't end. Without ``ttl_ms`` keys stay until their document changes."""
    prepared(events.sparkSession)
    return events.groupBy("document_id").transformWithStateInPandas(
        _Sources(ttl_ms), "key string, kind string, answer string, at timestamp", "Update", "ProcessingTime" if ttl_ms else "None")
