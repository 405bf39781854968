"""Operator 11 [native]: personal data by generated candidates and boosted trees.

Only DataFrame functions run here.  Base spans come from strict patterns whose matches
are checked (parts of an address, check digits, numbers of digits).  Looser patterns
propose candidates that may overlap each other and what the strict ones matched:
addresses of any script or with ``[at]``, single groups of a run of digits, numbers
without a plus.  Each candidate is a row of small numbers that describe its format and
its context but not the mark that the strict pattern asks for.  Boosted trees of two
levels learn, per kind, which candidates are base spans; a match that failed its check is
an example of what is none, but candidates that only overlap one, or overlap a base span
of their own kind, teach nothing.  Trees
are fitted by sums: equal rows of numbers are counted first, each level of a tree is one
aggregation of gradients by (kind, feature, value), and no row but those sums reaches
the driver.  A fifth of the texts is kept out of the trees and calibrates them: the
share of base spans by score, made monotone, sets for each kind the least score whose
share is ``SURE``.  Candidates at or above it that touch no base span are added; of
those that overlap one another the best stays.

Places are code points.  They come from the lengths of the pieces between matches,
summed in two levels, so a text with many matches costs no more per match.

Defined cases: null text is empty and has no spans; equal texts have equal spans and
teach once; a kind without base spans in the kept-out texts, or an empty table, adds
nothing; extra columns are ignored; very long texts are one value, as Spark has it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.llm.common import load, settle

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns; runs are taken whole (possessive), so that no run is read twice.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT = r"(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)"
_DOT = r"(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)"
_POINT = r"(?:\.|\[\.\]|\x20\.\x20)"
#: The looser patterns that propose candidates.
LOOSE = (
    rf"(?:(?<![\p{{L}}\p{{N}}._%+-])|\G)[\p{{L}}\p{{N}}._%+-]++{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)++",
    rf"(?<![0-9])[0-9]{{1,3}}{_POINT}[0-9]{{1,3}}{_POINT}[0-9]{{1,3}}{_POINT}[0-9]{{1,3}}(?![0-9])",
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5})(?![0-9])",
    r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-]{0,2})?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]{0,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
)
#: What a text must hold for a kind's patterns to be tried.
_GATES = (r"@|[\[(](?:at|AT)[\])]", r"[0-9]" + _POINT + r"[0-9]", r"[0-9][\x20.-]?[0-9]", r"[0-9]{3}")
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words before a number that say what it is, by class.
_WORDS = (r"(?i)tel|phone|call|fax|mob", r"(?i)card|visa|credit|amex|karte|tarjeta|carte", r"(?i)\bip\b|host|server|addr", r"(?i)mail|contact", r"(?i)\b(?:id|no|nr|ref|order|version|token|key|hash|v)\b")
LONGEST = 320
ROUNDS, RATE, SMOOTH = 16, 0.5, 1.0
SURE, BINS = 0.9, 4
_STEP = 512


def _running(lengths: Column) -> Column:
    """Running sums of an array, by blocks of ``_STEP``."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    grow = lambda a, x: F.concat(a, F.array(last(a) + x))
    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")), lambda b: F.slice(lengths, b * _STEP + 1, _STEP))
    inner = F.transform(blocks, lambda b: F.aggregate(b, none, grow))
    outer = F.aggregate(F.transform(inner, last), F.array(F.lit(0)), grow)
    return F.flatten(F.zip_with(inner, F.slice(outer, F.lit(1), F.size(outer) - 1), lambda b, o: F.transform(b, lambda x: x + o)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of its last digit."""

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(number, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _passes(kind: int, match: Column) -> Column:
    if kind == 1:
        return F.rlike(match, F.lit(rf"\A{_PART}\.{_PART}\.{_PART}\.{_PART}\z"))
    n = F.length(digits(match))
    if kind == 2:
        return F.when(n.between(16, 19), luhn(digits(match))).otherwise(False)
    return n.between(8, 15) if kind == 3 else F.lit(True)


def _located(docs: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """``docs`` with a column per (name, gate, pattern): array<struct(s, e, m, l, r)> of all matches with their places,
    the text before and after. Each step is a projection of its own, so no match is searched twice."""
    none = F.array().cast("array<string>")
    names = [n for n, _, _ in patterns]
    found = docs.withColumns({f"{n}_m": F.when(F.rlike("text", F.lit(g)), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for n, g, p in patterns})
    cut = found.withColumns({f"{n}_p": F.when(F.size(f"{n}_m") > 0, F.split("text", p, -1)).otherwise(none) for n, _, p in patterns})
    length = lambda n: F.transform(f"{n}_m", lambda m, i: F.length(F.get(f"{n}_p", i)) + F.length(m))
    ends = cut.withColumns({f"{n}_e": F.when(F.size(f"{n}_m") > 0, _running(length(n))) for n in names})

    def spans(n: str) -> Column:
        at = lambda i: F.get(f"{n}_e", i)
        one = lambda m, i: F.struct((at(i) - F.length(m)).alias("s"), at(i).alias("e"), m.alias("m"), F.substring(F.get(f"{n}_p", i), -16, 16).alias("l"), F.substring(F.get(f"{n}_p", i + 1), 1, 2).alias("r"))
        return F.transform(f"{n}_m", one)

    out = ends.withColumns({n: spans(n) for n in names})
    return out.drop(*[f"{n}_{x}" for n in names for x in "mpe"])


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, marks): checked spans (k, s, e), and all marks (what, k, s, e, m, l, r) of one pass over the
    texts; ``what`` is b for a base span, f for a match that failed, c for a candidate."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a match can't hold more than its text: gates are cheap, and most texts pass none
    tried = [(f"b{k}", g, p) for k, (g, p) in enumerate(zip((r"@", _GATES[1], r"[0-9][\x20-]?[0-9]", r"\+[0-9]"), BASE))]
    tried += [(f"c{k}", g, p) for k, (g, p) in enumerate(zip(_GATES, LOOSE))]
    seen = _located(text.withColumn("key", F.unhex(F.md5("text"))), tried)
    judged = lambda k: F.transform(f"b{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _passes(k, x["m"]).alias("ok")))
    good = lambda k: F.transform(F.filter(f"v{k}", lambda x: x["ok"]), lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    seen = seen.withColumns({f"v{k}": judged(k) for k in range(4)})

    def marks(k: int) -> Column:
        strict = F.transform(f"v{k}", lambda x: F.struct(F.when(x["ok"], "b").otherwise("f").alias("what"), F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("m"), F.lit("").alias("l"), F.lit("").alias("r")))
        fit = F.filter(f"c{k}", lambda x: x["e"] - x["s"] <= LONGEST)
        loose = F.transform(fit, lambda x: F.struct(F.lit("c").alias("what"), F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r")))
        return F.concat(strict, loose)

    return seen.select("doc_id", "key", F.concat(*map(good, range(4))).alias("base"), F.concat(*[marks(k) for k in range(4)]).alias("marks"))


FEATURES = ("digits", "groups", "widest", "first", "brackets", "signs", "before", "after", "check", "lead", "word", "letters", "points", "length", "ending")


def _features() -> dict[str, Column]:
    """Small numbers of a candidate m between l and r."""
    m, d = F.col("m"), digits(F.col("m"))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    least = lambda c, most: F.least(c, F.lit(most)).cast("int")
    beside = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).when(F.rlike(c, F.lit(r"^[0-9]$")), 4).when(F.rlike(c, F.lit(r"^\p{L}$")), 3).when(F.rlike(c, F.lit(r"^\s$")), 1).otherwise(2)
    word = F.lit(0)
    for i, w in enumerate(_WORDS, 1):
        word = F.when(F.rlike("l", F.lit(w)), i).otherwise(word)
    return {
        "digits": least(F.length(d), 24),
        "groups": least(F.size(groups), 8),
        "widest": least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), 20),
        "first": least(F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)), 20),
        "brackets": F.when(F.rlike(m, F.lit(r"[()\[\]]")), 1).otherwise(0),
        "signs": least(F.size(F.array_distinct(F.split(F.regexp_replace(m, r"[\p{L}\p{N}@+]", ""), ""))), 5),
        "before": beside(F.substring("l", -1, 1)),
        "after": beside(F.substring("r", 1, 1)),
        "check": F.when(F.length(d).between(12, 19), F.when(luhn(d), 1).otherwise(0)).otherwise(0),
        "lead": F.when(d == "", 10).otherwise(F.ascii(d) - 48),
        "word": word,
        "letters": least(F.floor(F.length(F.regexp_replace(m, r"\P{L}", "")) / 4), 8),
        "points": least(F.length(F.regexp_replace(m, r"[^.]", "")), 6),
        "length": least(F.floor(F.length(m) / 4), 16),
        "ending": least(F.length(F.regexp_extract(m, r"(\p{L}*)$", 1)), 8),
    }


def candidates(seen: DataFrame) -> DataFrame:
    """(key, k, s, e, features, label, free): candidates of distinct texts; label 1 for a base span, 0 for another that
    teaches, else null; free where no base span is touched."""
    marked = seen.filter(F.exists("marks", lambda x: x["what"] == "c")).groupBy("key").agg(F.first("marks").alias("marks"))  # equal texts have equal marks
    rows = marked.select("key", F.explode("marks").alias("x")).select("key", "x.*")
    one = rows.groupBy("key", "k", "s", "e").agg(
        *[F.max(F.col("what") == w).alias(w) for w in "bfc"], *[F.max(c).alias(c) for c in "mlr"]
    )

    def touched(mark: str, *by: str) -> Column:
        before = F.max(F.when(F.col(mark), F.col("e"))).over(Window.partitionBy(*by).orderBy("s"))
        after = F.min(F.when(F.col(mark), F.col("s"))).over(Window.partitionBy(*by).orderBy(F.col("s").desc()))
        return F.coalesce(before > F.col("s"), F.lit(False)) | F.coalesce(after < F.col("e"), F.lit(False))

    near = one.withColumns({"own_base": touched("b", "key", "k"), "own_failed": touched("f", "key", "k"), "any_base": touched("b", "key")})
    label = F.when(F.col("b"), 1).when(F.col("f") | (~F.col("own_base") & ~F.col("own_failed")), 0)
    found = near.filter("c").withColumns({"label": label, "free": ~F.col("b") & ~F.col("any_base")})
    return found.select("key", "k", "s", "e", "label", "free", *[c.alias(n) for n, c in _features().items()])


class Split(NamedTuple):
    """Rows whose feature is at most ``most`` go left."""

    feature: str
    most: int
    left: float | Split
    right: float | Split


class Model(NamedTuple):
    """Per kind: the margin before any tree, the trees, and the least bin of margins that is sure (None: nothing is)."""

    start: dict[int, float]
    trees: dict[int, list[Split]]
    least: dict[int, int]


def _value(tree: Split | float) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(F.col(tree.feature) <= tree.most, _value(tree.left)).otherwise(_value(tree.right))


def margin(start: dict[int, float], trees: dict[int, list[Split]]) -> Column:
    out = F.lit(-99.0)
    for k, base in start.items():
        total = F.lit(base)
        for tree in trees[k]:
            total = total + _value(tree)
        out = F.when(F.col("k") == k, total).otherwise(out)
    return out


def _bin(score: Column) -> Column:
    return F.greatest(F.lit(-16), F.least(F.lit(16), F.floor(score * BINS))).cast("int")


def _best(sums: list[tuple[str, int, float, float]]) -> tuple[str, int, float, float] | None:
    """The split of highest gain (feature, most, left value, right value) from (feature, value, gradient, weight)."""
    worth = lambda g, h: g * g / (h + SMOOTH)
    leaf = lambda g, h: round(RATE * g / (h + SMOOTH), 6)
    best = None
    for name in FEATURES:
        mine = sorted((v, g, h) for f, v, g, h in sums if f == name)
        all_g, all_h = sum(g for _, g, _ in mine), sum(h for _, _, h in mine)
        left_g = left_h = 0.0
        for v, g, h in mine[:-1]:
            left_g, left_h = left_g + g, left_h + h
            gain = round(worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h), 6)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, name, v, leaf(left_g, left_h), leaf(all_g - left_g, all_h - left_h))
    return best and best[1:]


def fit(found: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Trees and thresholds from labelled candidates. What is read again and again is the counts of equal rows, whose
    number is bounded by the features' values; a round reads them twice."""
    kept_out = F.pmod(F.crc32("key"), F.lit(5)) == 0
    counted = settle(found.filter("label IS NOT NULL").groupBy("k", kept_out.alias("out"), "label", *FEATURES).agg(F.count("*").alias("n")), "counted")
    learnt = counted.filter("NOT out")
    totals = {(r["k"], r["label"]): r["n"] for r in learnt.groupBy("k", "label").agg(F.sum("n").alias("n")).collect()}
    start = {k: math.log((totals.get((k, 1), 0) + 1) / (totals.get((k, 0), 0) + 1)) for k in range(4) if totals.get((k, 1))}
    trees: dict[int, list[Split]] = {k: [] for k in start}
    both = [k for k in start if totals.get((k, 0))]
    for _ in range(rounds if both else 0):
        p = 1 / (1 + F.exp(-margin(start, trees)))
        graded = learnt.filter(F.col("k").isin(both)).select("k", *FEATURES, ((F.col("label") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))

        def sums(rows: DataFrame) -> dict[tuple[int, int], list]:
            cell = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("v")) for f in FEATURES])).alias("cell")
            out: dict[tuple[int, int], list] = {}
            for r in rows.select("k", "side", "g", "h", cell).groupBy("k", "side", "cell.f", "cell.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out.setdefault((r["k"], r["side"]), []).append((r["f"], r["v"], r["g"], r["h"]))
            return out

        roots = {k: _best(s) for (k, _), s in sums(graded.withColumn("side", F.lit(0))).items()}
        roots = {k: r for k, r in roots.items() if r}
        if not roots:
            break
        side = F.lit(0)
        for k, (f, most, _, _) in roots.items():
            side = F.when(F.col("k") == k, F.when(F.col(f) <= most, 0).otherwise(1)).otherwise(side)
        below = sums(graded.filter(F.col("k").isin(list(roots))).withColumn("side", side))
        for k, (f, most, left, right) in sorted(roots.items()):
            halves = [_best(below.get((k, s), [])) for s in (0, 1)]
            trees[k].append(Split(f, most, *[Split(*half) if half else leaf for half, leaf in zip(halves, (left, right))]))
    bins = counted.filter("out").filter(F.col("k").isin(list(start))).groupBy("k", _bin(margin(start, trees)).alias("bin")).agg(F.sum(F.col("n") * F.col("label")).alias("yes"), F.sum("n").alias("n")).collect()
    return Model(start, trees, {k: t for k in start if (t := threshold([(r["bin"], r["yes"], r["n"]) for r in bins if r["k"] == k], sure)) is not None})


def threshold(bins: list[tuple[int, int, int]], sure: float) -> int | None:
    """The least bin from which on the share of yes, made monotone by pooling neighbours, is sure (add-one counts)."""
    pools: list[list[int]] = []  # first bin, yes, n
    for at, yes, n in sorted(bins):
        pools.append([at, yes, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, yes, n = pools.pop()
            pools[-1][1:] = [pools[-1][1] + yes, pools[-1][2] + n]
    good = [at for at, yes, n in pools if (yes + 1) / (n + 2) >= sure]
    return min(good, default=None)


def added(found: DataFrame, model: Model) -> DataFrame:
    """(key, more): the spans that the model adds to a text."""
    enough = F.lit(False)
    for k, least in model.least.items():
        enough = enough | ((F.col("k") == k) & (F.col("bin") >= least))
    scored = found.filter("free").withColumn("score", margin(model.start, model.trees)).withColumn("bin", _bin(F.col("score"))).filter(enough).select("key", "k", "s", "e", "score")
    by_place = Window.partitionBy("key").orderBy("s", "e", "k")
    apart = F.col("s") >= F.coalesce(F.max("e").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    island = scored.withColumn("apart", apart).withColumn("island", F.sum(F.col("apart").cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("score", (F.col("e") - F.col("s")).alias("wide"), (-F.col("s")).alias("early"), (-F.col("k")).alias("kind"), "k", "s", "e")).alias("x")
    one = island.groupBy("key", "island").agg(best).select("key", F.struct("x.k", "x.s", "x.e").alias("x"))
    return one.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): checked spans, and those together with what the model adds, as array<struct(k, s, e)> by kind and start."""
    seen = settle(scanned(docs), "scanned")
    found = settle(candidates(seen), "candidates")
    model = fit(found)
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    if not model.least:
        return seen.select("doc_id", "base", F.col("base").alias("spans"))
    more = settle(added(found, model), "added", after=(found,))
    marked = F.size("marks") > 0  # others have nothing to look up
    joined = seen.filter(marked).join(more, "key", "left").select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("more", none))).alias("spans"))
    return joined.unionByName(seen.filter(~marked).select("doc_id", "base", F.col("base").alias("spans")))


def told(spans: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
