"""Plain versions of the operators, for tests: quadratic, in memory, straight from the definitions."""

import hashlib
import re
from collections import Counter, defaultdict
from math import log10

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs, width):
    seen = Counter(tuple(w[i : i + width]) for _, t in docs for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingle_set(text):
    w = words(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs):
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)]


def line_dedup(docs, least=20, documents=3):
    keyed = [(d, [(ln, low(ln.strip(" \t\n\v\f\r"))) for ln in (t or "").split("\n")]) for d, t in docs]
    held = defaultdict(list)
    for d, lines in keyed:
        for k in {k for _, k in lines if len(k) >= least}:
            held[k].append(-(2**63) if d is None else d)
    out = []
    for d, lines in keyed:
        me = -(2**63) if d is None else d
        kept = [ln for ln, k in lines if not (len(held.get(k, ())) >= documents and max(held[k]) != me)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def unigram(docs, held_out):
    spoken = [(d, words(low(t)) + [None]) for d, t in docs]  # None: the end
    c = Counter()
    for d, ws in spoken:
        if not held_out(d):
            c.update(ws)
    n, v = sum(c.values()), len(c)
    return [(d, held_out(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in spoken]


def targets(totals, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, active, out = share * sum(totals.values()), list(names), {}
    while active:
        total = sum(weight[s] for s in active)
        above = [s for s in active if left * weight[s] / total > cap * totals[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in active}
            break
        out |= {s: cap * totals[s] for s in above}
        left -= sum(out[s] for s in above)
        active = [s for s in active if s not in out]
    return out


def coverage(text, item, least=5):
    """(share of the item's words under tiles, tiles) by greedy string tiling: the longest match of unmarked words first."""
    a = re.findall(r"\w+", (item or "").casefold())
    b = re.findall(r"\w+", (text or "").casefold())
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), 0
    while a:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:  # ties: the first place in the item, then in the text
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        tiles += 1
    return (free_a.count(False) / len(a) if a else 0.0), tiles


def leaks(docs, items, threshold=0.5):
    """[(doc_id, item_ids, n_items, coverage, contaminated)] of (doc_id, text) against (item_id, text)."""
    out = []
    for d, t in docs:
        found = [(i, *coverage(t, x)) for i, x in items if x is not None]
        ids = sorted(i for i, c, _ in found if c >= threshold)
        out.append((d, ids, len(ids), max((c for _, c, n in found if n), default=0.0), int(bool(ids))))
    return out
