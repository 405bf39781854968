"""Streams: continuous ingest of files, and kept messages; further keyed state is in ``state``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskiln.plans import ingest
from corpuskiln.sources.buckets import Buckets


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """New files become corpus tables in buckets of documents; each file counts once, a file that fails is an error row."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{docx,doc,txt}").load(folder)

    store = Buckets(spark, out)

    def commit(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch, like a file that has changed, replaces its documents' rows in all tables
        ingest.ingested(batch, store)

    return raw.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_messages(messages: DataFrame, most: int = 100) -> DataFrame:
    """Per conversation, how many messages it keeps and the oldest kept id, as messages arrive."""

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for pdf in batches:
            kept += pdf["message_id"].astype(int).tolist()
        kept = sorted(set(kept))[-most:]
        state.update((kept,))
        yield pd.DataFrame({"conversation_id": [key[0]], "n_kept": [len(kept)], "oldest": [kept[0]]})

    return messages.groupBy("conversation_id").applyInPandasWithState(update, "conversation_id long, n_kept long, oldest long", "kept array<long>", "update", GroupStateTimeout.NoTimeout)

