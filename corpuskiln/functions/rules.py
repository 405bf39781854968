"""Rule engine: ordered patterns become one CASE expression, so a rule set costs one pass."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    patterns: tuple[str, ...]
    priority: int = 0
    confidence: float = 1.0


@dataclass(frozen=True)
class Override:
    name: str
    patterns: tuple[str, ...]
    flags: dict = field(default_factory=dict)


FLAGS = ("is_legal_lookup", "use_multi_article", "needs_expansion")


def usable(patterns) -> tuple[str, ...]:
    """Patterns that compile and can match; others are skipped, as a rule file may hold tombstones."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        if p and p != "(?!)":
            out.append(p)
    return tuple(out)


def load_rules(path: str | Path) -> dict:
    """Rules of a JSON (or, where a YAML parser is installed, YAML) file:
    structural_rules, routing, prototype_sentences, flag_overrides."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    data = data or {}
    rules = [Rule(r["intent_id"], usable(r.get("patterns", ())), int(r.get("priority", 0)), float(r.get("confidence", 1.0))) for r in data.get("structural_rules", ())]
    return {
        "structural": sorted(rules, key=lambda r: -r.priority),  # stable: file order among equals
        "routing": {k: usable(v) for k, v in data.get("routing", {}).items()},
        "prototypes": data.get("prototype_sentences", {}),
        "overrides": [Override(o["name"], usable(o.get("patterns", ())), o.get("set_flags", {})) for o in data.get("flag_overrides", ())],
    }


def matches(text: Column, patterns, flags: str = "(?iuU)") -> Column:
    """Whether any pattern is found; one alternation, Unicode case folding and classes."""
    patterns = usable(patterns)
    return F.rlike(text, F.lit(flags + "(?:" + "|".join(patterns) + ")")) if patterns else F.lit(False)


def first_match(text: Column, rules: list[Rule], flags: str = "(?iuU)") -> Column:
    """struct(label, confidence) of the first rule by priority, then order; null without one."""
    out = None
    for r in sorted(rules, key=lambda r: -r.priority):
        if not usable(r.patterns):
            continue
        value = F.struct(F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"))
        hit = matches(text, r.patterns, flags)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("struct<label:string,confidence:double>")


def keyword_confidence(text: Column, words: list[str]) -> Column:
    """min(0.5 + 0.15 * distinct keywords contained, 0.9); null without any."""
    low = F.lower(text)  # one expression, so it is evaluated once; inside a lambda it would be for each word
    n = sum((F.contains(low, F.lit(w)).cast("int") for w in dict.fromkeys(words)), F.lit(0))
    return F.when(n > 0, F.round(F.least(0.5 + 0.15 * n, F.lit(0.9)), 6))


def labelled(text: Column, vocabulary: dict[str, list[str]], semantic: Column | None = None, n: int = 2, fallback: str = "general") -> Column:
    """The best n labels as array<struct(confidence, label)>: keyword confidences, plus 0.1 on a
    label that ``semantic`` (map label -> similarity of at least its threshold) already has."""
    parts = []
    for label, words in vocabulary.items():
        k = keyword_confidence(text, words)
        s = semantic[label] if semantic is not None else F.lit(None).cast("double")
        conf = F.when(s.isNotNull() & k.isNotNull(), F.least(s + 0.1, F.lit(0.95))).otherwise(F.coalesce(s, k))
        parts.append(F.struct((-F.round(conf, 3)).alias("by"), F.lit(label).alias("label")))
    some = F.slice(F.array_sort(F.filter(F.array(*parts), lambda x: x["by"].isNotNull())), 1, n)
    named = F.transform(some, lambda x: x["label"])
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(fallback)))


def flag_pipeline(text: Column, label: Column, base: dict[str, tuple[bool, bool, bool]], narrow, synthesis, substantive, statutory, overrides: list[Override]) -> Column:
    """struct of the three flags, in this order: base by label, narrow boost, synthesis,
    substantive, sync (overwrites lookup and multi), statutory force, first override."""
    lookup, multi, expand = (F.coalesce(*[F.when(label == k, F.lit(v[i])) for k, v in base.items()], F.lit(False)) for i in range(3))
    lookup = lookup | matches(text, narrow)
    multi = multi | matches(text, synthesis) | matches(text, substantive)
    known = label.isin(*base)
    lookup = F.when(known, F.coalesce(*[F.when(label == k, F.lit(v[0])) for k, v in base.items()], F.lit(False))).otherwise(lookup)
    multi = F.when(known, F.coalesce(*[F.when(label == k, F.lit(v[1])) for k, v in base.items()], F.lit(False))).otherwise(multi)
    force = matches(text, statutory)
    multi, expand = multi | force, expand | force
    out = [lookup, multi, expand]
    for o in reversed(overrides):
        hit = matches(text, o.patterns)
        out = [F.when(hit, F.lit(bool(o.flags.get(f, False)))).otherwise(v) for f, v in zip(FLAGS, out)]
    return F.struct(*[v.alias(f) for f, v in zip(FLAGS, out)])


def strategies(scores: dict[str, Column], n: int = 2, least: float = 0.0) -> Column:
    """The n best-scored names above ``least``, ties in declared order."""
    parts = [F.struct((-F.round(s, 6)).alias("by"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, (k, s) in enumerate(scores.items())]
    some = F.filter(F.array_sort(F.array(*parts)), lambda x: x["by"] < -least)
    return F.transform(F.slice(some, 1, n), lambda x: x["name"])


def first_mapped(text: Column, mapping: dict[str, list[str]]) -> Column:
    """The first value of an ordered mapping one of whose patterns is found; null without one."""
    out = None
    for value, patterns in mapping.items():
        hit = matches(text, patterns)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("string")


def metadata_filters(query: Column, maps: dict[str, dict[str, list[str]]], unless: dict[tuple[str, str], list[str]] | None = None) -> Column:
    """struct of what a question restricts: a value per mapping (not where one of its ``unless`` phrases makes it another
    expression), the year (after 'năm', else a lone 20xx) and the article."""
    low = F.lower(query)
    parts = []
    for name, mapping in maps.items():
        value = first_mapped(low, mapping)
        for (of, wrong), phrases in (unless or {}).items():
            if of == name:
                value = F.when((value == wrong) & F.rlike(low, F.lit("|".join(map(re.escape, phrases)))), F.lit(None)).otherwise(value)
        parts.append(value.alias(name))
    part = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    year = F.coalesce(part(r"(?U)năm\s+(20\d{2})"), part(r"(?U)\b(20\d{2})\b")).cast("int")
    return F.struct(*parts, year.alias("year"), part(r"(?U)điều\s+(\d+[a-z]?)").alias("article"))


def sort_wanted(query: Column, orders: dict[str, list[str]], default: str = "relevance") -> Column:
    """The order that a question asks for by one of its phrases (newest, oldest, ...), else the default."""
    return F.coalesce(first_mapped(F.lower(query), orders), F.lit(default))


def situation(query: Column, maps: dict[str, dict[str, list[str]]], unknown: dict[str, str]) -> Column:
    """struct of what a local case is about (subject, violation, severity, ...), ``unknown`` where no phrase says so."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return F.struct(*[F.coalesce(first_mapped(low, m), F.lit(unknown[name])).alias(name) for name, m in maps.items()])


def analysis(query: Column, maps: dict[str, dict[str, list[str]]], orders: dict[str, list[str]], cases: dict[str, dict[str, list[str]]], unknown: dict[str, str], signals: tuple[str, ...], stopwords: list[str] = (), phrases: list[str] = ()) -> Column:
    """struct(filters, keywords, sort, situation) of a question; the situation is null unless one of its ``signals`` is known."""
    case = situation(query, cases, unknown)
    known = F.lit(False)
    for name in signals:
        known = known | (case[name] != unknown[name])
    return F.struct(metadata_filters(query, maps).alias("filters"), query_keywords(query, list(stopwords), list(phrases)).alias("keywords"), sort_wanted(query, orders).alias("sort"), F.when(known, case).alias("situation"))


def query_keywords(query: Column, stopwords: list[str], phrases: list[str], least: int = 3) -> Column:
    """Phrases of two words first, then words of ``least`` letters that are neither stopwords nor numbers; each once."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    none = F.array().cast("array<string>")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(none)
    known = F.filter(pairs, lambda p: p.isin(*phrases)) if phrases else none
    single = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords, "") & ~F.rlike(w, F.lit(r"^\d+$")))
    return F.array_distinct(F.concat(known, single))


def in_scope(query: Column, strong, blocked: list[str], context_words: list[str] = (), context=()) -> Column:
    """Whether a question is the engine's business: a strong pattern says so; a blocked word, or a context word without its
    context patterns, says no; anything else passes, blank ones don't."""
    low = F.lower(F.coalesce(query, F.lit("")))
    has = lambda words: F.rlike(low, F.lit("|".join(map(re.escape, words)))) if words else F.lit(False)
    stray = has(list(context_words)) & ~matches(low, context)
    return F.when(F.trim(low) == "", False).when(matches(low, strong), True).otherwise(~(has(blocked) | stray))
