"""Pages of an ordered table, found by their number or by a key.

The table is put in order once, by a range partitioning; every row gets its page, and rows
are written in folders of pages with an index of each page's first key.  A page is then the
read of one folder, wherever it lies, and a reader that stopped goes on behind the last key
it has seen.  Nothing is sorted or skipped per request.

Defined cases: ties of the order are broken by the key, which must be unique for ``after`` to
miss nothing; pages count from 0; a page beyond the last one is empty; so are all of an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.sources.tables import scratch, written


def numbered(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Rows with their place (0, 1, ...) in an order of all: each partition of a range partitioning goes on where the one before ends."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = written(rows.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name="ordered")
    part, before, offsets = F.shiftright("_at", 33), 0, []
    for row in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):  # a row a partition
        offsets.append((row["part"], before))
        before += row["count"]
    offset = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.join(F.broadcast(offset), part == F.col("_part")).withColumn(into, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


@dataclass(frozen=True)
class Pages:
    """``rows``: the table with _place, _page and _folder; ``index``: _page, first (key), _folder."""

    rows: DataFrame
    index: DataFrame
    key: str
    total: int

    @classmethod
    def build(cls, table: DataFrame, key: str, size: int = 20, order: list[Column] | None = None, folder: int = 1000, at: str | None = None) -> Pages:
        """Writes ``table`` in pages of ``size`` rows, ``folder`` pages a folder, ordered by ``order`` and then ``key``."""
        at = at or scratch(table.sparkSession, "pages")
        placed = numbered(table, [*(order or []), F.col(key)], "_place")
        placed = placed.withColumn("_page", F.floor(F.col("_place") / size)).withColumn("_folder", F.floor(F.col("_page") / folder))
        rows = written(placed.repartition("_folder").sortWithinPartitions("_folder", "_place"), f"{at}/rows", by=("_folder",))
        first = rows.groupBy("_page", "_folder").agg(F.min_by(key, "_place").alias("first"), F.count("*").alias("n"))
        index = written(first, f"{at}/index")
        return cls(rows, index, key, index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def page(self, n: int) -> DataFrame:
        """The rows of a page, in order, with ``total``."""
        folder = [r["_folder"] for r in self.index.filter(F.col("_page") == n).collect()]
        return self._read(folder, F.col("_page") == n)

    def after(self, key, n: int | None = None) -> DataFrame:
        """The rows behind the one with this key: the rest of its page and the next one, at most ``n``."""
        mine = self.rows.filter(F.col(self.key) == key).select("_place", "_page").first() if n is None or n > 0 else None
        if mine is None:
            return self._read([], F.lit(False))
        folders = [r["_folder"] for r in self.index.filter(F.col("_page").between(mine["_page"], mine["_page"] + 1)).collect()]
        rows = self._read(folders, (F.col("_place") > mine["_place"]) & (F.col("_page") <= mine["_page"] + 1))
        return rows.limit(n) if n else rows

    def _read(self, folders: list[int], where: Column) -> DataFrame:
        some = self.rows.filter(F.col("_folder").isin(folders) & where).orderBy("_place")
        return some.drop("_place", "_page", "_folder").withColumn("total", F.lit(self.total))
