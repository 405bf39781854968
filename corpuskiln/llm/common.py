"""Pieces that several training-data operators share.

Row identity: inputs may repeat ``doc_id`` or leave it null, so operators that
must come back to a document after a shuffle use ``row_key`` (a 64-bit hash of
id and text).  Rows that agree in both have equal results by definition.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: documents can be long, so a batch stays small.
ARROW_ROWS = 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("\x00")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one is made only where none is set and
    executors are threads of this machine (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuskiln-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str, after: tuple[DataFrame, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts the lineage: writes to the shared folder as Parquet and reads back, so
    lost executors cost no recomputation of what lies before.  ``after``: settled
    tables that nothing needs any more once this one is written; they are deleted.
    ``by``: columns that are folders, the last ones of ``df``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    for table in after:
        release(table)
    return out


def release(table: DataFrame) -> None:
    """Deletes a settled table."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.settled_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, changed where ``docs`` has such a column already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """The session with other settings (dots written as __) while something runs."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The texts as UTF-8 bytes, without decoding them."""
    if pa.types.is_string(column.type):
        return column.cast(pa.binary()).to_pylist()
    return column.cast(pa.large_binary()).to_pylist()


class Names(dict):
    """word -> 64-bit name.  The same word has the same name in every task; the
    cache is emptied when full, which only costs time."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode() if isinstance(word, str) else word)
        return found

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache for all operators: a Python worker serves several of them in turn.
WORD_NAMES = Names()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def inverse(base: int = _ODD) -> int:
    return pow(base, -1, 1 << 64)


def window_prints(names: np.ndarray, width: int, base: int = _ODD) -> np.ndarray:
    """A 64-bit print of each ``width`` consecutive names (polynomial, wrapped)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(base) + names[i : i + n]
    return mix(total)


def crc_of_id(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as crc 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread(df: DataFrame) -> int:
    """Shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def numbered(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Rows with their number (1, 2, ...) in an order of all rows: a range partitioning, and in each partition the
    numbers after those of the partitions before it."""
    placed = rows.repartitionByRange(spread(rows), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(placed, "ordered")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):  # one row per partition
        offsets.append((row["part"], before))
        before += row["count"]
    offset = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offset), part == F.col("_part")).withColumn(into, F.col("_before") + within + 1).drop("_at", "_part", "_before")
