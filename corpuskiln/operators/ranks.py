"""Rank operators over rows keyed by query: every order carries a tie-break."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: str | list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: str | list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return ranked(df, by, order, name).filter(F.col(name) <= k)


def first_by_key(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    return top_k(df, key, order, 1, "_first").drop("_first")


def union(parts: list[DataFrame], by: str = "query_id") -> DataFrame:
    """The rows of all parts, which may each be ordered by windows over ``by``. Spark 4.1 then pairs the parts' partitions, and
    fails where adaptive execution has given them different numbers; a column that is computed claims no partitioning."""
    parted = [df.withColumn(by, F.element_at(F.array(by), 1)) for df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parted)


def rrf(lists: list[DataFrame], key: list[str], k: int = 60, rank: str = "rank", score: str = "score") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (1-based ranks) within ``query_id``.

    An item adds 1/(k + rank) per appearance; its representative is the row of
    highest ``score`` (first list on ties).  Only ids, ranks and scores travel.
    """
    cols = ["query_id", *key, rank, score]
    every = union([df.select(*cols, F.lit(i).alias("list")) for i, df in enumerate(lists)])
    fused = every.groupBy("query_id", *key).agg(
        F.sum(1.0 / (k + F.col(rank))).alias("rrf_score"),
        F.max(score).alias(score),
        F.min(F.struct(F.col("list"), F.col(rank)))["list"].alias("first_list"),
    )
    return ranked(fused, "query_id", [F.round("rrf_score", 12).desc(), *[F.col(c) for c in key]])


def diversified(df: DataFrame, group: str, least: int = 3, top: int = 5, rank: str = "rank") -> DataFrame:
    """If the first ``top`` rows cover ``least`` groups, groups take turns in order of
    appearance; rows without a group go last. Otherwise the order stays. Adds ``new_rank``."""
    q = Window.partitionBy("query_id")
    covered = F.size(F.collect_set(F.when(F.col(rank) <= top, F.col(group))).over(q)) >= least
    turn = F.row_number().over(Window.partitionBy("query_id", group).orderBy(rank))
    first = F.min(rank).over(Window.partitionBy("query_id", group))
    marked = df.withColumns({"_turns": covered, "_turn": turn, "_first": first})
    order = [F.when(F.col("_turns"), F.col(group).isNull().cast("int")), F.when(F.col("_turns") & F.col(group).isNotNull(), F.col("_turn")), F.when(F.col("_turns") & F.col(group).isNotNull(), F.col("_first")), F.col(rank)]
    return ranked(marked, "query_id", order, "new_rank").drop("_turns", "_turn", "_first")


def dynamic_cap(df: DataFrame, score: str, group: str, rank: str = "rank", amendment: Column | None = None) -> DataFrame:
    """How many groups a query keeps: 5, 3 or 1 by the gap of the two best scores and the groups in the first five rows."""
    at = lambda n: F.max(F.when(F.col(rank) == n, F.col(score)))
    hint = F.bool_or(amendment) if amendment is not None else F.lit(False)
    stats = df.groupBy("query_id").agg(F.count("*").alias("n"), (at(1) - at(2)).alias("gap"), F.count_distinct(F.when(F.col(rank) <= 5, F.col(group))).alias("groups"), hint.alias("amendment"))
    gap = F.round("gap", 9)
    cap = F.when(F.col("amendment"), 5).when(F.col("n") < 2, 1).when((gap < 0.10) & (F.col("groups") >= 3), 5).when((gap < 0.20) & (F.col("groups") >= 2), 3).otherwise(1)
    return stats.select("query_id", cap.cast("long").alias("cap"))


def with_cap(df: DataFrame, score: str, group: str, rank: str = "rank") -> DataFrame:
    """Rows with their query's ``cap`` (as ``dynamic_cap``), in windows over the same few ranked rows instead of a second pass."""
    q = Window.partitionBy("query_id")
    at = lambda n: F.max(F.when(F.col(rank) == n, F.col(score))).over(q)
    gap = F.round(at(1) - at(2), 9)
    groups = F.size(F.collect_set(F.when(F.col(rank) <= 5, F.col(group))).over(q))
    cap = F.when(F.count("*").over(q) < 2, 1).when((gap < 0.10) & (groups >= 3), 5).when((gap < 0.20) & (groups >= 2), 3).otherwise(1)
    return df.withColumn("cap", cap.cast("long"))


def penalised(df: DataFrame, score: str, query_labels: str, labels: str, penalty: float = 0.30) -> Column:
    """Score minus a penalty when both label sets are known and disjoint."""
    apart = (F.size(query_labels) > 0) & (F.size(labels) > 0) & ~F.arrays_overlap(query_labels, labels)
    return F.col(score) - F.when(apart, penalty).otherwise(0.0)


def boosted(score: Column, allowed: Column, label: Column, boost: float = 0.12) -> Column:
    return score + F.when(F.coalesce(F.array_contains(allowed, label), F.lit(False)), boost).otherwise(0.0)


def soft_filter(df: DataFrame, matches: Column, by: str = "query_id") -> DataFrame:
    """Keeps matching rows, unless a group has none: then all of it."""
    some = F.max(F.coalesce(matches, F.lit(False)).cast("int")).over(Window.partitionBy(by))
    return df.withColumns({"_m": F.coalesce(matches, F.lit(False)), "_some": some}).filter("_m OR _some = 0").drop("_m", "_some")


def group_scores(df: DataFrame, groups: list[str], score: str) -> DataFrame:
    sums = df.groupBy("query_id", *groups).agg(F.round(F.sum(score), 6).alias("group_score"), F.count("*").alias("n_rows"))
    return ranked(sums, "query_id", [F.col("group_score").desc(), *[F.col(c) for c in groups]], "group_rank")


def quota(df: DataFrame, by: str, order: list[Column], most: int, groups: int | Column = 1, over: str | None = None) -> DataFrame:
    """``max(1, most // groups)`` first rows of each group. With ``over`` (such as query_id), ``groups`` is the number
    of groups of each value of it, and no value keeps more than ``most`` rows: groups take turns, first rows first."""
    if over is None:
        return top_k(df, by, order, max(1, most // max(1, groups)), "in_group")
    n = df.groupBy(over).agg(F.count_distinct(by).alias("_n"))
    rows = ranked(df, [over, by], order, "in_group").join(n, over)
    rows = rows.filter(F.col("in_group") <= F.greatest(F.lit(1), F.floor(most / F.col("_n")))).drop("_n")
    return top_k(rows, over, [F.col("in_group"), F.col(by), *order], most, "_all").drop("_all")


def budget_prefix(df: DataFrame, by: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each group up to the first that would overflow the budget."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", total).filter(F.col("running") <= budget)


def newest(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return top_k(df, by, order, n, "_age").drop("_age")
