"""Operator 5 [native]: license scans with a positional rare-token index.

Only DataFrame functions run here.  ``TEMPLATES`` holds the wordings of licences and
notices as word lists, each with the phrases that must stand in it.  How many
documents have each licence word gives its IDF; each template's ``RARE`` words of
highest IDF form the index word -> (template, position).  A file's words are looked
up in it; every hit votes for the template standing at (place in file - place in
template), if all mandatory phrases stand at their own relative places.  Votes that
agree are summed: a template is found where hits worth ``SHARE`` of its indexed IDF
agree.  One pass over the texts counts words, the next one finds base places and
votes; texts never leave their task, only verified votes (a few numbers) are shuffled.

Variants differ in their phrases (the third clause of BSD, the versions of the GNU
licences, the condition that MIT-0 lacks) and have labels of their own.

Base labels come from the phrases of ``BASE``, wherever their words stand
consecutively.  ``score`` is 1 with a base place, else the best IDF share.

Defined cases: null text is empty and has no words; a licence word at the very
start or end counts like any other; repeated rows get equal results; a tie of
IDF is broken by the word; extra columns are ignored; an empty table gives an
empty result; a very long text is one array of words in its task.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm.common import load, lower_ascii, row_key, settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that give base labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
#: Wordings of widely used licences and notices; label, words, phrases that must stand in them.
TEMPLATES = (
    ("0bsd", f"{_ISC} the software is provided as is and the author disclaims all warranties", ("permission to use copy modify", "is hereby granted the software is provided as is")),
    ("agpl", _GNU.format("affero general public license", "3"), ("gnu affero general public license", "either version 3 of the license")),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd-2-clause", "in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is", ("materials provided with the distribution", "this software is provided by the copyright holders")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("nor the names of its contributors", "endorse or promote products derived from this software")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy", "covered by this license")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("the accompanying materials", "eclipse public license 2 0")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "either version 3 of the license or at your option any later version", ("at your option any later version",)),
    ("gpl-2.0", _GNU.format("general public license", "2"), ("gnu general public license", "either version 2 of the license")),
    ("gpl-3.0", _GNU.format("general public license", "3"), ("gnu general public license", "either version 3 of the license")),
    ("isc", _ISC, ("permission to use copy modify",)),
    ("isc-notice", f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "this permission notice appear in all copies")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl-2.1", _GNU.format("lesser general public license", "2 1"), ("gnu lesser general public license", "either version 2 1 of the license")),
    ("lgpl-3.0", _GNU.format("lesser general public license", "3"), ("gnu lesser general public license", "either version 3 of the license")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("mit-0", f"{_MIT} the software is provided as is", ("permission is hereby granted free of charge", "furnished to do so the software is provided as is")),
    ("mit-notice", f"{_MIT} subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "subject to the following conditions", "this permission notice shall be included in all copies")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0", "if a copy of the mpl was not distributed")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("unlicense-full", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software", "as a compiled binary for any purpose")),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
)
RARE, SHARE = 4, 0.6


def words(text: str = "text") -> Column:
    """Lower-cased words. ``lower`` is quicker than A-Z alone and does the same to ASCII words, but for
    the two letters whose lower case has ASCII letters."""
    raw = F.coalesce(F.col(text), F.lit(""))
    odd = F.contains(raw, F.lit("\u212a")) | F.contains(raw, F.lit("\u0130"))
    return F.regexp_extract_all(F.when(odd, lower_ascii(raw)).otherwise(F.lower(raw)), F.lit(WORD), F.lit(0))


def _find(haystack: list[str], needle: list[str]) -> int:
    return next(i for i in range(len(haystack)) if haystack[i : i + len(needle)] == needle)


def document_counts(spoken: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each licence word (one number per word of the templates)."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    held = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    counts = spoken.select(F.explode(F.concat(held, F.array(F.lit("\x00")))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counts}
    return found.pop("\x00", 0), {w: found.get(w, 0) for w in vocabulary}


def rare_index(n: int, counts: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """(word, template, position, share of the template's indexed IDF)."""
    idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in counts.items()}
    out = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        ws = notice.split()
        best = sorted(set(ws), key=lambda w: (-idf[w], w))[:RARE]
        total = sum(idf[w] for w in ws if w in best)
        out += [(w, t, i, idf[w] / total) for i, w in enumerate(ws) if w in best]
    return sorted(out)


def votes(index: list[tuple[str, int, int, float]]) -> Column:
    """array<struct(template, start, place, share)> of a text's ``words``: what its indexed words vote for, where every
    mandatory phrase of the template stands at its place."""
    rare = sorted({w for w, *_ in index})
    posting = {w: F.array(*[F.struct(F.lit(t).alias("template"), F.lit(i).alias("place"), F.lit(s).alias("share")) for v, t, i, s in index if v == w]) for w in rare}
    postings = F.create_map(*[x for w in rare for x in (F.lit(w), posting[w])])
    parts = lambda t: [(_find(TEMPLATES[t][1].split(), p.split()), p.split()) for p in TEMPLATES[t][2]]
    phrases = F.create_map(*[x for t in range(len(TEMPLATES)) for x in (F.lit(t), F.array(*[F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, ws)).alias("ws")) for at, ws in parts(t)]))])
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda h: h["word"].isin(*rare))
    cast = lambda h: F.transform(postings[h["word"]], lambda p: F.struct(p["template"].alias("template"), (h["i"] - p["place"]).alias("start"), p["place"].alias("place"), p["share"].alias("share")))

    def stand(v: Column) -> Column:
        at = lambda f: v["start"] + f["at"]
        return F.forall(phrases[v["template"]], lambda f: (at(f) >= 0) & (F.slice("words", F.greatest(at(f) + 1, F.lit(1)), F.size(f["ws"])) == f["ws"]))

    found = F.filter(F.flatten(F.transform(hits, cast)), stand)
    none = F.array().cast("array<struct<template:int,start:int,place:int,share:double>>")
    return F.when(F.arrays_overlap("words", F.array(*map(F.lit, rare))), found).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: words, base places and labels, all labels, score, and where templates start."""
    spoken = docs.select("doc_id", row_key().alias("key"), words().alias("words"))
    index = rare_index(*document_counts(spoken))

    def stands(phrase: str, i: Column) -> Column:
        ws = phrase.split()
        last = F.get("words", i) == ws[-1]
        for k, w in enumerate(ws[:-1]):
            last = last & (F.get("words", i - (len(ws) - 1 - k)) == w)
        return last

    def places(phrase: str) -> Column:
        size = len(phrase.split())
        ends = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.coalesce(stands(phrase, i), F.lit(False)))
        starts = F.transform(ends, lambda i: i - (size - 1))
        return F.when(F.array_contains("words", phrase.split()[-1]), starts).otherwise(F.array().cast("array<int>"))

    seen = settle(spoken.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), *[places(p).alias(f"p{k}") for k, (p, _) in enumerate(BASE)], votes(index).alias("votes")), "licences")
    cast = seen.filter("size(votes) > 0").select("key", F.explode("votes").alias("v")).select("key", "v.*").distinct()  # equal rows vote once
    agreed = cast.groupBy("key", "template", "start").agg(F.round(F.sum("share"), 9).alias("share")).filter(F.col("share") >= SHARE)
    label = F.element_at(F.array(*[F.lit(x) for x, _, _ in TEMPLATES]), F.col("template") + 1)
    found = agreed.groupBy("key").agg(F.collect_set(label).alias("more"), F.max("share").alias("share"), F.sort_array(F.collect_set("start")).alias("template_starts"))
    every = F.concat(*[F.col(f"p{k}") for k in range(len(BASE))])
    marks = F.array_distinct(F.concat(*[F.when(F.size(f"p{k}") > 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>")) for k, (_, x) in enumerate(BASE)]))
    based = seen.select("doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), marks.alias("base"))
    none = F.array().cast("array<string>")
    return based.join(found, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", F.coalesce("more", none)))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"),
        F.coalesce("template_starts", F.array().cast("array<int>")).alias("template_starts"),
    )


def scan_plain(text: str | None, index: list[tuple[str, int, int, float]]) -> dict:
    """The same by brute force, for tests: every template at every place of one text."""
    ws = re.findall(WORD, (text or "").translate({i: i + 32 for i in range(65, 91)}))
    base = [(i, x) for p, x in BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    more, best = set(), 0.0
    for t, (x, notice, phrases) in enumerate(TEMPLATES):
        parts = [(_find(notice.split(), p.split()), p.split()) for p in phrases]
        for start in range(-len(notice.split()), len(ws)):
            if not all(start + at >= 0 and ws[start + at : start + at + len(p)] == p for at, p in parts):
                continue
            share = round(sum(s for w, u, i, s in index if u == t and 0 <= start + i < len(ws) and ws[start + i] == w), 9)
            if share >= SHARE:
                more.add(x)
                best = max(best, share)
    labels = {x for _, x in base}
    return {"n_words": len(ws), "n_base": len(base), "first_word": min((i for i, _ in base), default=None), "last_word": max((i for i, _ in base), default=None), "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | more)), "score": 1.0 if base else min(1.0, best)}


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents")).drop("template_starts")


def _values(rows) -> str:
    show = lambda x: f"'{x}'" if isinstance(x, str) else "[" + ", ".join(map(show, x)) + "]" if isinstance(x, (list, tuple)) else str(x)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t AS (SELECT template, label, string_split(notice, ' ') AS nw, list_transform(phrases, lambda p: string_split(p, ' ')) AS pws FROM (VALUES {_values((i, *row) for i, row in enumerate(TEMPLATES))}) AS v(template, label, notice, phrases)),
slots AS (SELECT template, unnest(nw) AS w, generate_subscripts(nw, 1) - 1 AS place FROM t),
held AS (SELECT w, count(*) AS c FROM (SELECT unnest(list_distinct(ws)) AS w FROM docs) WHERE w IN (SELECT w FROM slots) GROUP BY w),
idf AS (SELECT s.w, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (coalesce(any_value(c), 0) + 1)) + 1 AS idf FROM slots s LEFT JOIN held h ON s.w = h.w GROUP BY s.w),
best AS (SELECT template, w, idf FROM (SELECT DISTINCT template, w FROM slots) JOIN idf USING (w) QUALIFY row_number() OVER (PARTITION BY template ORDER BY idf DESC, w) <= {RARE}),
entry AS (SELECT template, w, place, idf / sum(idf) OVER (PARTITION BY template) AS share FROM slots JOIN best USING (template, w)),
ats AS (SELECT template, label, pws, list_transform(pws, lambda pw: list_filter(generate_series(1, len(nw)), lambda i: list_slice(nw, i, i + len(pw) - 1) = pw)[1] - 1) AS offs FROM t),
maybe AS (
  SELECT k, ws, template, label, pws, offs, unnest(list_filter(generate_series(1, len(ws) - len(pws[1]) + 1), lambda i: list_slice(ws, i, i + len(pws[1]) - 1) = pws[1])) - 1 - offs[1] AS start
  FROM docs, ats WHERE list_contains(ws, pws[1][len(pws[1])]) AND len(ws) >= len(pws[1])),
found AS (SELECT k, template, label, start FROM maybe WHERE list_bool_and(list_transform(generate_series(1, len(pws)), lambda j: start + offs[j] >= 0 AND list_slice(ws, greatest(start + offs[j] + 1, 1), start + offs[j] + len(pws[j])) = pws[j]))),
voted AS (
  SELECT k, label, round(sum(share), 9) AS share FROM found JOIN docs USING (k) JOIN entry USING (template)
  WHERE start + place >= 0 AND ws[start + place + 1] = w GROUP BY k, template, label, start HAVING round(sum(share), 9) >= {SHARE}),
more AS (SELECT k, list(DISTINCT label) AS labels, max(share) AS share FROM voted GROUP BY k),
b AS (SELECT string_split(phrase, ' ') AS pw, label FROM (VALUES {_values(BASE)}) AS v(phrase, label)),
base AS (
  SELECT k, label, unnest(list_filter(generate_series(1, len(ws) - len(pw) + 1), lambda i: list_slice(ws, i, i + len(pw) - 1) = pw)) - 1 AS i
  FROM docs, b WHERE list_contains(ws, pw[len(pw)]) AND len(ws) >= len(pw)),
based AS (SELECT k, count(*) AS n, min(i) AS f, max(i) AS l, list(DISTINCT label) AS labels FROM base GROUP BY k)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(based.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE least(1.0, coalesce(more.share, 0.0)) END::DOUBLE AS score
FROM docs LEFT JOIN based USING (k) LEFT JOIN more USING (k)
"""
