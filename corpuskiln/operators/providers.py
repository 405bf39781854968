"""Pluggable models: embedder, reranker, generator, rewriter; the defaults are deterministic and offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import text as X


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class HashedTokens:
    """L2-normalised signed counts of hashed tokens; a blank text embeds like a space."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(self.dim, np.float32)
            for w in (text or " ").lower().split() or [" "]:
                h = xxhash.xxh64_intdigest(w.encode())
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)


def embedded(df: DataFrame, text: str = "text", provider: Embedder | None = None, name: str = "embedding") -> DataFrame:
    provider = provider or HashedTokens()

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return provider(s)

    return df.withColumn(name, embed(F.coalesce(F.col(text), F.lit(" "))))


def overlap_rerank(query: Column, text: Column) -> Column:
    """The offline cross-encoder: token overlap of query and text."""
    return F.round(X.keyword_overlap(X.token_set(query), X.token_set(text)), 6)


def extractive_answer(contexts: DataFrame, most: int = 3) -> DataFrame:
    """The offline generator: the first grouped passages of each query, or a fixed no-answer text."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("rank", "text"))), 1, most)
    return contexts.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(best, lambda x: x["text"]), "\n\n").alias("answer"))


def rewrite(query: Column, abbreviations: dict[str, str], least: int = 8, most: int = 400) -> Column:
    """Abbreviations spelled out, where the length gate lets a query be rewritten and the result is safe."""
    out = query
    for short, full in abbreviations.items():
        out = F.regexp_replace(out, rf"(?iU)\b{short}\b", full)
    gate = F.length(query).between(least, most)
    safe = (F.length(out) <= F.greatest(4 * F.length(query), F.lit(300))) & ~F.contains(out, F.lit("\n\n"))
    return F.when(gate & safe, out).otherwise(query)


def variants(queries: DataFrame, most: int = 3, templates: tuple[str, ...] = ("what is %s", "details about %s")) -> DataFrame:
    """One row per variant of each query: the original first, templates next, no repeats."""
    made = F.array_distinct(F.concat(F.array("query"), *[F.array(F.format_string(t, F.lower(F.trim("query")))) for t in templates]))
    some = F.slice(F.filter(made, lambda v: F.length(v) > 8), 1, most)
    return queries.select("query_id", F.posexplode(some).alias("variant", "query")).withColumn("variant", F.col("variant").cast("long"))


class Model(Protocol):
    """What a slot runs: made by a ``load`` function in the worker, called with lists of rows' columns."""

    def __call__(self, *columns: list) -> list: ...


#: Models of this worker by the function that loads them: one load however many batches and tasks follow.
_LOADED: dict[Any, Model] = {}


def served(df: DataFrame, inputs: list[Column], load: Callable[[], Model], returns: str, name: str, batch: int = 64) -> DataFrame:
    """``df`` with ``name``: struct<value: returns, error: string> of a model over ``inputs``.

    The model is loaded once in a worker.  Rows of an Arrow batch are sorted by length and given to it ``batch`` at a time, so
    short texts aren't padded to long ones.  A batch that fails is tried row by row; a row that fails alone is a row with its
    error, not a failed job.  Null inputs are given as they are."""
    key = f"{getattr(load, '__module__', '')}.{getattr(load, '__qualname__', id(load))}"

    @F.pandas_udf(f"struct<value:{returns},error:string>")
    def serve(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        if key not in _LOADED:
            _LOADED[key] = load()
        model = _LOADED[key]
        for columns in parts:
            columns = columns if isinstance(columns, tuple) else (columns,)
            size = sum(c.map(lambda v: len(v) if isinstance(v, str) else 0) for c in columns).to_numpy()
            order = np.argsort(size, kind="stable")
            values: list = [None] * len(size)
            errors: list = [None] * len(size)
            for at in range(0, len(order), batch):
                mine = order[at : at + batch]
                rows = [[c.iloc[i] for i in mine] for c in columns]
                try:
                    for i, v in zip(mine, model(*rows), strict=True):
                        values[i] = v
                except Exception:  # noqa: BLE001 - whatever a model throws concerns its rows only
                    for j, i in enumerate(mine):
                        try:
                            (values[i],) = model(*[[r[j]] for r in rows])
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"[:200]
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "error": errors})

    return df.withColumn(name, serve(*inputs))


def reranked_by(pairs: DataFrame, load: Callable[[], Model], query: str = "query", text: str = "text", name: str = "rerank_score") -> DataFrame:
    """Pairs scored by a cross-encoder in a slot; a pair that failed has score 0 and its error in ``<name>_error``."""
    out = served(pairs, [F.col(query), F.col(text)], load, "double", "_served")
    return out.withColumns({name: F.coalesce("_served.value", F.lit(0.0)), f"{name}_error": F.col("_served.error")}).drop("_served")


def classified_by(queries: DataFrame, load: Callable[[], Model], query: str = "query", least: float = 0.35) -> DataFrame:
    """Questions with a classifier's ``label`` and ``confidence``; a label below ``least`` is null, as is that of a failed row."""
    out = served(queries, [F.col(query)], load, "struct<label:string,confidence:double>", "_served")
    sure = F.coalesce(F.col("_served.value.confidence"), F.lit(0.0))
    return out.withColumns({"label": F.when(sure >= least, F.col("_served.value.label")), "confidence": sure, "error": F.col("_served.error")}).drop("_served")


def reply_intent(reply: Column, valid: tuple[str, ...], aliases: dict[str, str] | None = None, none: str = "nan") -> Column:
    """struct<intent, confidence> of a model's reply: what stands behind ``intent:`` (0.85), older names by their new ones, or
    the first valid name anywhere in it (0.72); null and 0 where there is neither."""
    low = F.lower(F.trim(F.coalesce(reply, F.lit(""))))
    said = F.nullif(F.regexp_extract(low, r"intent:\s*([a-z0-9_]+)", 1), F.lit(""))
    named = F.coalesce(*[F.when(said == old, F.lit(new)) for old, new in (aliases or {}).items()], said)
    stated = F.when(named.isin(*valid, none), named)
    found = F.coalesce(*[F.when(F.contains(low, F.lit(v)), F.lit(v)) for v in valid])
    confidence = F.when(stated.isNotNull(), 0.85).when(found.isNotNull(), 0.72).otherwise(0.0)
    return F.struct(F.coalesce(stated, found).alias("intent"), confidence.alias("confidence"))
