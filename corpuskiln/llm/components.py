"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.common import release, settle


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b); comp is the smallest node of the component.

    Each round a node takes the smallest label among itself and its neighbours,
    then the label of its label; rounds grow with the logarithm of a
    component's width.  Labels are aggregated before the shuffle, so a node
    with very many links is no single task's load.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp")), "labels")
    table = labels
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("next"))
        up = labels.select(F.col("node").alias("n2"), F.col("comp").alias("above"))
        moved = stepped.join(up, F.col("next") == F.col("n2")).select("node", F.col("comp").alias("old"), F.least("next", "above").alias("comp"))
        table = settle(moved, "labels", after=(table,))
        labels = table.select("node", "comp")
        if table.filter("old != comp").isEmpty():
            release(both)
            return labels
