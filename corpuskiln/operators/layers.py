"""Layered classification: what several detectors say about a question, put in order, calibrated and routed.

A detector's verdict is a struct(label, confidence), null where it has none; layers are a coalesce, so
detectors that aren't reached cost what their column costs and nothing is iterated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import rules as U

VERDICT = "struct<label:string,confidence:double>"
#: The label without a verdict, labels of the communal level's boost signals, thresholds.
FALLBACK = "hoi_dap_chung"
COMMUNE_SIGNALS = ("địa bàn", "xã", "phường", "thôn", "ông/bà", "tham mưu", "ra quân", "vi phạm", "xử lý", "tình huống")
COMMUNE_PLACE = r"(?iuU)\b(xã|thôn|phường|ubnd\s*xã|thôn\s*trưởng)\b"
COMMUNE_ACT = r"(?iuU)(xử\s*lý|can\s*thiệp|chỉ\s*đạo|giải\s*quyết|cơ\s*quan\s+nào|ra\s*xã|lên\s*xã)"


def verdict(label: Column | str, confidence: Column | float) -> Column:
    lab = F.lit(label) if isinstance(label, str) else label
    conf = F.lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return F.struct(lab.alias("label"), conf.cast("double").alias("confidence"))


def classifier_verdict(scores: Column, out_of_scope: str = "nan", least: float = 0.50, scope: float = 0.20) -> Column:
    """The best of a classifier's map label -> probability: none below ``least``, out of scope below ``scope``."""
    best = F.get(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("by"), e["key"].alias("label")))), F.lit(0))
    top = -best["by"]
    return F.when(top < scope, verdict(out_of_scope, top)).when(top >= least, verdict(best["label"], top))


def calibrated(query: Column, found: Column, method: Column, communal: tuple[str, ...] = (), out_of_scope: str = "nan") -> Column:
    """A verdict's confidence: less for models on very short questions, more for communal labels with a communal
    word, to two places; out of scope is capped only."""
    conf, words = found["confidence"], F.size(F.split(F.trim(query), r"\s+"))
    short = F.when((method == "llm") & (words <= 2), F.greatest(conf - 0.10, F.lit(0.40))).when((method == "llm") & (words <= 4), F.greatest(conf - 0.05, F.lit(0.50))).otherwise(conf)
    low, signal = F.lower(query), F.lit(False)
    for s in COMMUNE_SIGNALS:
        signal = signal | F.contains(low, F.lit(s))
    raised = found["label"].isin(*communal) & method.isin("llm", "semantic", "classifier") & signal if communal else F.lit(False)
    out = F.when(raised, F.least(short + 0.05, F.lit(0.95))).otherwise(short)
    return F.round(F.when(found["label"] == out_of_scope, F.least(conf, F.lit(0.95))).otherwise(out), 2)


def guard(query: Column) -> Column:
    """The verdict on empty, very short and letterless questions."""
    q = F.trim(F.coalesce(query, F.lit("")))
    return F.when(F.length(q) < 3, verdict(FALLBACK, 0.10)).when(~F.rlike(q, F.lit("[a-zA-ZÀ-ỹ]")), verdict(FALLBACK, 0.15))


def layered(query: Column, classifier: Column | None = None, semantic: Column | None = None, structural: Column | None = None, model: Column | None = None, communal: tuple[str, ...] = ()) -> Column:
    """struct(label, confidence, method): guard, classifier, prototypes, rules, model, in this order."""
    none = F.lit(None).cast(VERDICT)
    stopped = guard(query)
    out = F.when(stopped.isNotNull(), F.struct(stopped["label"].alias("label"), stopped["confidence"].alias("confidence"), F.lit("guard").alias("method")))
    last = model if model is not None else verdict(FALLBACK, 0.30)
    for name, found in (("classifier", classifier), ("semantic", semantic), ("structural", structural), ("llm", F.coalesce(last, verdict(FALLBACK, 0.30)))):
        found = found if found is not None else none
        out = out.when(found.isNotNull(), F.struct(found["label"].alias("label"), calibrated(query, found, F.lit(name), communal).alias("confidence"), F.lit(name).alias("method")))
    return out


def layered_by_rules(query: Column, classifier: Column | None = None, structural: Column | None = None, semantic: Column | None = None) -> Column:
    """struct(label, confidence) without a model: classifier, rules, the communal rule, prototypes, fallback."""
    none = F.lit(None).cast(VERDICT)
    communal = F.when(F.rlike(query, F.lit(COMMUNE_PLACE)) & F.rlike(query, F.lit(COMMUNE_ACT)), verdict("admin_scenario", 0.90))
    pick = [x if x is not None else none for x in (classifier, structural)] + [communal, semantic if semantic is not None else none, verdict(FALLBACK, 0.30)]
    return F.when(F.trim(F.coalesce(query, F.lit(""))) == "", verdict(FALLBACK, 0.10)).otherwise(F.coalesce(*pick))


def bundle(by_rules: Column, by_model: Column, mode: str = "rule") -> Column:
    """struct(label, confidence, routed, method): ``rule`` routes by the rules, ``model`` by the model where it has a verdict,
    ``shadow`` by the rules while showing the model's label."""
    seen = F.coalesce(by_model, by_rules) if mode in ("model", "shadow") else by_rules
    routed = F.coalesce(by_model, by_rules) if mode == "model" else by_rules
    method = F.when(F.lit(mode) == "rule", "rule").when(by_model.isNull(), "rule").otherwise(mode)
    return F.struct(seen["label"].alias("label"), seen["confidence"].alias("confidence"), routed["label"].alias("routed"), method.alias("method"))


def domain_hits(text: Column, vocabulary: dict[str, list[str]], semantic: Column | None = None, n: int = 3, fallback: str = "chung") -> Column:
    """The n best domains as array<struct(confidence, domain, method)>: similarities of at least their threshold (map ``semantic``),
    0.1 more where a keyword says the same, else the keyword's own confidence; only ``fallback`` (0.30) without any."""
    parts = []
    for i, (domain, words) in enumerate(vocabulary.items()):
        k = U.keyword_confidence(text, words)
        s = semantic[domain] if semantic is not None else F.lit(None).cast("double")
        conf = F.round(F.when(s.isNotNull() & k.isNotNull(), F.least(s + 0.1, F.lit(0.95))).otherwise(F.coalesce(s, k)), 3)
        said = F.when(s.isNotNull(), "semantic").otherwise("keyword")
        parts.append(F.struct((-conf).alias("by"), s.isNull().cast("int").alias("late"), F.lit(i).alias("i"), F.lit(domain).alias("domain"), said.alias("method")))
    some = F.slice(F.array_sort(F.filter(F.array(*parts), lambda x: x["by"].isNotNull())), 1, n)
    named = F.transform(some, lambda x: F.struct((-x["by"]).alias("confidence"), x["domain"].alias("domain"), x["method"].alias("method")))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.struct(F.lit(0.30).alias("confidence"), F.lit(fallback).alias("domain"), F.lit("fallback").alias("method"))))


def domain_filter(hits: Column, fallback: str = "chung", also: Column | None = None, extra: str | None = None) -> Column:
    """Domains to filter by, null for none: the two first ones sure to 0.60, else the two first keyword hits of 0.50;
    ``extra`` joins where ``also`` holds; three at most."""
    named = lambda rows: F.slice(F.transform(rows, lambda x: x["domain"]), 1, 2)
    real = F.filter(hits, lambda x: x["domain"] != fallback)
    sure = F.filter(real, lambda x: x["confidence"] >= 0.60)
    said = F.filter(real, lambda x: (x["method"] == "keyword") & (x["confidence"] >= 0.50))
    out = F.when(F.size(sure) > 0, named(sure)).when(F.size(said) > 0, named(said))
    if extra is not None:
        out = F.when(out.isNotNull() & also & ~F.array_contains(out, extra), F.concat(out, F.array(F.lit(extra)))).otherwise(out)
    return F.slice(out, 1, 3)


def document_labels(hits: Column, least: float = 0.38, most: int = 5, fallback: str = "chung") -> Column:
    """Labels of a document: those of at least ``least``; without one the two best; else the fallback."""
    real = F.filter(hits, lambda x: x["domain"] != fallback)
    names = lambda rows, n: F.slice(F.transform(rows, lambda x: x["domain"]), 1, n)
    good = F.filter(real, lambda x: x["confidence"] >= least)
    return F.when(F.size(good) > 0, names(good, most)).when(F.size(real) > 0, names(real, 2)).otherwise(F.array(F.lit(fallback)))


def margin_route(one: Column, other: Column, undecided: Column | bool = False, margin: float = 0.10) -> Column:
    """Whether the first of two similarities wins by the margin; within it, what an arbiter says."""
    undecided = F.lit(undecided) if isinstance(undecided, bool) else undecided
    gap = F.round(one - other, 9)
    return F.when(gap >= margin, True).when(-gap >= margin, False).otherwise(F.coalesce(undecided, F.lit(False)))


def merged_utterance(label: Column, said: Column, low: float = 0.35, high: float = 0.52) -> Column:
    """The label after a model's verdict on the utterance (struct label, confidence): replaced from ``high`` on, filled in
    where it was missing from ``low`` on."""
    conf = said["confidence"]
    return F.when(said["label"].isNotNull() & ((conf >= high) | (label.isNull() & (conf >= low))), said["label"]).otherwise(label)


def learned_prototypes(articles: DataFrame, groups: dict[str, list[str]], first: int = 300) -> DataFrame:
    """(label, text) of articles whose beginning holds a keyword; the first group that does gives the label."""
    start = F.lower(F.substring(F.concat_ws(". ", "title", "content"), 1, first))
    label = F.lit(None).cast("string")
    for name, words in reversed(groups.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(start, F.lit(w.lower()))
        label = F.when(hit, name).otherwise(label)
    return articles.select(label.alias("label"), F.concat_ws(". ", "title", F.substring("content", 1, first)).alias("text")).filter("label IS NOT NULL")


def routed(questions: DataFrame, label: str, routes: dict[str, str], default: str = "general") -> DataFrame:
    """Questions with the ``route`` of their label."""
    names = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return questions.withColumn("route", F.coalesce(names[F.col(label)], F.lit(default)))


def dispatched(questions: DataFrame, handlers: dict, default: str = "general") -> DataFrame:
    """Each question answered by its route's handler (DataFrame -> DataFrame of one schema); unknown routes go to the default."""
    out, known = None, [r for r in handlers if r != default]
    for route, handler in handlers.items():
        mine = questions.filter(~F.col("route").isin(*known)) if route == default else questions.filter(F.col("route") == route)
        part = handler(mine)
        out = part if out is None else out.unionByName(part)
    return out


def prototype_stats(prototypes: DataFrame) -> DataFrame:
    """(label, n, share) of the prototypes."""
    n = prototypes.groupBy("label").agg(F.count("*").alias("n"))
    total = prototypes.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))
