"""Corpus tables in buckets of documents.

Every table lies in folders by a hash of ``document_id``, so a document and all that
belongs to it are in the bucket of one number, table by table.  A change reads and
writes the buckets of the documents it names and no others, and deletes cascade without
a shuffle between tables.  New contents of buckets are written aside first and then put
in place by Spark's dynamic partition overwrite, children before documents; a change
that stops midway is repaired by running it again.

Defined cases: a table that isn't there yet is created by the first change; rows with a
null id share a bucket; a bucket that becomes empty is removed; a document without rows
in a table leaves none there.  A DataFrame that was read before a change reads files
that the change has removed: ask for the table again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.sources.tables import exists, written

BUCKET = "_bucket"


class Buckets:
    """Tables by name below ``at``, each with a column ``document_id``."""

    def __init__(self, spark: SparkSession, at: str, buckets: int = 256):
        self.spark, self.at, self.buckets = spark, at.rstrip("/"), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def _shape(self, name: str) -> str:
        return f"{self.at}/_schemas/{name}"

    def stored(self, name: str) -> DataFrame | None:
        """The table with its bucket column, or None where it doesn't exist. Columns are kept aside, as a table may be empty."""
        if not exists(self.spark, self._shape(name)):
            return None
        schema = self.spark.read.parquet(self._shape(name)).schema
        if not exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(self.path(name))

    def table(self, name: str) -> DataFrame:
        found = self.stored(name)
        if found is None:
            raise ValueError(f"no table {name} at {self.at}")
        return found.drop(BUCKET)

    def of(self, name: str, ids: list[int]) -> DataFrame:
        """The rows of some documents: only their buckets are opened."""
        touched = [r[0] for r in self.spark.createDataFrame([(i,) for i in ids], "document_id long").select(self.bucket()).distinct().collect()]
        return self.stored(name).filter(F.col(BUCKET).isin(touched) & F.col("document_id").isin(ids)).drop(BUCKET)

    def replace(self, tables: dict[str, DataFrame], ids: DataFrame) -> list[int]:
        """All rows of the documents ``ids`` become those of ``tables``; the touched buckets are returned. Ids may be many:
        they stay a table, only bucket numbers reach the driver."""
        ids = written(ids.select("document_id").distinct().withColumn(BUCKET, self.bucket()), name="ids")
        touched = sorted(r[0] for r in ids.select(BUCKET).distinct().collect())  # ``buckets`` numbers at most
        gone = ids.select("document_id", F.lit(True).alias("_gone"))
        for name, rows in sorted(tables.items(), key=lambda t: t[0] == "documents"):
            new = rows.withColumn(BUCKET, self.bucket())
            old = self.stored(name)
            if old is not None:
                kept = old.filter(F.col(BUCKET).isin(touched)).join(gone.select("document_id"), "document_id", "left_anti")
                new = new.unionByName(kept, allowMissingColumns=True)
            merged = written(new.repartition(BUCKET), name=name)
            if old is None or sorted(old.columns) != sorted(merged.columns):
                merged.limit(0).coalesce(1).write.mode("overwrite").parquet(self._shape(name))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path(name))
            left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
            if old is not None:
                self._remove(name, [b for b in touched if b not in left])
        return touched

    def delete(self, ids: DataFrame) -> list[int]:
        """Documents and all that belongs to them are gone from every table."""
        return self.replace({n: self.table(n).limit(0) for n in self.names()}, ids)

    def names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/_schemas")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []

    def _remove(self, name: str, buckets: list[int]) -> None:
        for b in buckets:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{BUCKET}={b}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
