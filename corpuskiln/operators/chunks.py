"""Table-generating text operators on plain text: windows and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, STEP = 512, 432


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), " "), lambda w: w != "")


def token_windows(docs: DataFrame, text: str = "text", size: int = SIZE, step: int = STEP) -> DataFrame:
    """Overlapping windows: one when a text has at most ``size`` words, else every ``step`` words until the end."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, words_of(text).alias("_w")).filter(F.size("_w") > 0)
    last = F.ceil(F.greatest(F.size("_w") - size, F.lit(0)) / F.lit(float(step))).cast("long")
    cut = rows.select(*keep, "_w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    start = F.col("chunk") * step
    return cut.select(*keep, "chunk", start.alias("start"), F.slice("_w", (start + 1).cast("int"), size).alias("words"))


def islands(docs: DataFrame, key: str, header: str, text: str = "text") -> DataFrame:
    """Lines with the running number of the header above them (0 before the first)."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line_no", F.col("line_no").cast("long"))
    head = F.rlike("line", F.lit(header)).cast("long")
    return lines.withColumn("article", F.sum(head).over(Window.partitionBy(key).orderBy("line_no")))
