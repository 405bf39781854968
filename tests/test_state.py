"""Keyed state on file streams: restarts, expiry, late rows, invalidation."""

from datetime import datetime, timedelta

import pytest

from corpuskiln.streaming import state

T0 = datetime(2026, 1, 1, 12, 0, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


class Run:
    """A query over a folder of Parquet files that ends when all is read; state lives in its checkpoint."""

    def __init__(self, spark, tmp_path, schema, transform, mode):
        self.spark, self.path, self.schema, self.transform, self.mode, self.n = spark, tmp_path, schema, transform, mode, 0
        (tmp_path / "in").mkdir()

    def __call__(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        out = []
        stream = self.transform(self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in/*"))
        query = stream.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.path}/check").trigger(availableNow=True)
        query.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).start().awaitTermination()
        return sorted(out, key=str)


@pytest.fixture
def run(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield lambda *a: Run(spark, tmp_path, *a)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_conversations_come_back_after_a_restart(run):
    step = run("conversation_id long, kind string, message_id long, text string, at timestamp", lambda s: state.conversations(s, 3, 2), "update")
    first = [(1, "message", i, f"m{i}", at(i)) for i in range(5)] + [(1, "document", None, d, at(9)) for d in "ab"] + [(2, "message", 7, "x", at(0))]
    assert step(first) == [(1, 3, 2, ["a", "b"]), (2, 1, 7, [])]
    # each call is a new query on the old checkpoint: a message again, one too old, a new one, one more document
    assert step([(1, "message", 4, "m4", at(10)), (1, "message", 0, "m0", at(11)), (1, "message", 9, "m9", at(12)), (1, "document", None, "c", at(13)), (1, "noise", 1, "?", at(13))]) == [(1, 3, 3, ["b", "c"])]
    assert step([(3, "document", None, "z", at(14))]) == [(3, 0, None, ["z"])]


def test_cache_expires_by_event_time(run):
    step = run("key string, kind string, answer string, at timestamp", lambda s: state.answer_cache(s, ttl_ms=60 * 60_000, late="5 minutes"), "append")
    assert step([("k", "put", "A", at(0)), ("k", "get", None, at(30)), ("q", "get", None, at(30))]) == [("k", at(30), "hit", "A"), ("q", at(30), "miss", None)]
    # 59 minutes old: still there, also after the restart; a put renews
    assert step([("k", "get", None, at(59))]) == [("k", at(59), "hit", "A")]
    assert step([("k", "put", "B", at(60)), ("k", "get", None, at(119))]) == [("k", at(119), "hit", "B")]
    # at its end it misses, whether or not the timer has run
    assert ("k", at(120), "miss", None) in step([("k", "get", None, at(120))])
    # the watermark passes the end: the timer tells
    assert ("k", at(120), "expired", None) in step([("z", "get", None, at(200))]) + step([("z", "get", None, at(201))])


def test_late_rows_are_dropped(run):
    step = run("key string, kind string, answer string, at timestamp", lambda s: state.answer_cache(s, ttl_ms=60 * 60_000, late="5 minutes"), "append")
    step([("k", "put", "new", at(100))])
    step([("other", "get", None, at(101))])  # the watermark of the first batch holds from here on
    assert step([("k", "put", "too late", at(10)), ("k", "get", None, at(102))]) == [("k", at(102), "hit", "new")]


def test_dropped_answers_miss(run):
    step = run("key string, kind string, answer string, at timestamp", lambda s: state.answer_cache(s, late="5 minutes"), "append")
    step([("k", "put", "A", at(0))])
    assert step([("k", "drop", None, at(1)), ("k", "get", None, at(2))]) == [("k", at(2), "miss", None)]


def test_a_changed_document_gives_its_keys_out(run):
    step = run("document_id long, kind string, key string, at timestamp", lambda s: state.invalidations(s, None), "update")
    assert step([(1, "source", "k1", at(0)), (1, "source", "k2", at(1)), (2, "source", "k2", at(1))]) == []
    assert step([(1, "changed", None, at(5)), (3, "changed", None, at(5))]) == [("k1", "drop", None, at(5)), ("k2", "drop", None, at(5))]
    assert step([(1, "changed", None, at(6)), (2, "changed", None, at(6))]) == [("k2", "drop", None, at(6))]
