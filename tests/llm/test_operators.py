"""Each operator against its plain version, on a fixture with every awkward row."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import jaccard, licenses, linededup, lm, media, mixing, mphf, sharding, substrings, tiling, toxicity
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, name string"


def corpus(seed=3):
    r = random.Random(seed)
    vocab = ["the", "of", "ab", "cd", "ef", "Word", "word", "x.", "é", "naïve", "ß", "I", "zz"] + [f"v{i}" for i in range(300)]
    say = lambda n, k=300: " ".join(r.choice(vocab[: k + 13]) for _ in range(n))
    passage, base = say(60), say(120)
    line = "This Line stands in many documents "
    rows = [None, "", " \n\t ", "one", "one", "One", "a b c d e", "a b c d e", "the " * 200, "the " * 90, "ab cd " * 80]
    rows += [say(40) + " " + passage + " " + say(r.randint(0, 40)) for _ in range(6)]
    for _ in range(8):  # near copies
        w = base.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = say(1)
        rows.append(" ".join(w))
    rows += [base.upper(), base.replace(" ", "\n")]
    rows += [f"{say(5)}\n  {line.upper()}\t\n{say(4)}\n{line}" for _ in range(4)]
    rows += [say(3000), say(50, 3)]
    rows += ["released under the MIT License. " + say(5), "GNU General\nPublic-License, version 3", "mit license mit license", "Licensed under CC BY-NC 4.0."]
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [(5, base), (5, base), (None, base), (None, None), (10**12, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", random.Random(str(i)).choice(["a", "b", "c", None]), len(t or ""), 7, "clash") for i, (d, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def same(got, want):
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("width", [5, 35])
def test_substrings(docs, width):
    got = substrings.dedup_substrings(docs, width=width, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, plain.substrings(corpus(), width))


def test_substring_spans(spark):
    w = [f"w{i}" for i in range(100)]
    d = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(["q", *w[10:60], "z"]))], "doc_id long, text string")
    rows = {r.doc_id: r for r in substrings.dedup_substrings(d).collect()}
    assert [tuple(x) for x in rows[1].removed] == [(10, 60)] and rows[2].kept_text == "q z"


def test_symbols_are_global():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 40, 500).astype(np.uint64)
    both = np.concatenate([words, rng.integers(0, 40, 7).astype(np.uint64), words[100:300]])
    lengths = np.array([500, 207])
    doc, a, b, name, _ = substrings.anchors(both, lengths, 35)
    at = {(d, p): n for d, x, y, n in zip(doc, a, b, name) for p in range(x, y + 1)}
    assert all(at[0, 100 + i] == at[1, 7 + i] for i in range(200 - 35 + 1))


def test_jaccard(docs):
    got = jaccard.similar(docs).select("doc_id", "n_shingles", "component_id").collect()
    same(got, plain.components(corpus()))


@pytest.mark.parametrize("held", [4096, 7])  # the second: tiles in pieces
def test_jaccard_near_copy_cluster(spark, held, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", held)
    r = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):  # pairwise similarity on both sides of the threshold
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(jaccard.similar(d).select("doc_id", "n_shingles", "component_id").collect(), plain.components(rows))


def test_bitmap_bounds_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        words = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b))) // 8
        x = np.bitwise_count(jaccard.fold([jaccard.bitmap(a)], words) ^ jaccard.fold([jaccard.bitmap(b)], words)).sum()
        assert x <= len(np.setxor1d(a, b))


def test_distances_of_blocks():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**60, 1200).astype(np.uint64)
    sets = [np.unique(rng.permutation(pool[:k])[: k - d]) for k in (40, 300, 1200) for d in (0, 3, 9)] + [pool[:1] for _ in range(2)]
    n, bits = np.array([len(x) for x in sets]), [jaccard.bitmap(x) for x in sets]
    got = jaccard.distances(n, bits, n, bits, 80)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
                assert 0 <= got[i, j] <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("limit, shard, group", [(linededup.BROADCAST_BYTES, 200_000, 10), (1 << 20, 5, 10), (0, 200_000, 500_000), (0, 5, 2)])
def test_line_dedup(docs, limit, shard, group, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard)
    monkeypatch.setattr(linededup, "GROUP_PROBES", group)
    got = linededup.dedup_lines(docs, keep_text=False, broadcast_bytes=limit).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    same(got, plain.line_dedup(corpus()))


def test_line_shard_needs_fingerprint_and_count():
    keys, documents = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3
    counts, keepers = np.arange(4000) % 5, np.arange(4000) * 10
    levels, rest = mphf.build(keys)
    order = np.argsort(mphf.Slots(levels, rest)(keys))
    row = {"levels": levels, "rest": rest, "prints": linededup.prints(keys[order]).tobytes(), "counts": np.minimum(counts[order], documents).astype(np.uint8).tobytes(), "keepers": keepers[order][counts[order] >= documents].tobytes()}
    shard = linededup.Shard(row, documents)
    assert np.array_equal(shard.dropped(keys, keepers + (np.arange(4000) % 2)), (counts >= 3) & (np.arange(4000) % 2 == 1))
    assert not shard.dropped(keys + np.uint64(1), keepers + 1).any()  # lines that aren't in the index
    assert sum(len(x) for x in levels) < 4000  # packed bits


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    slots = mphf.Slots(*mphf.build(keys))(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (mphf.Slots(*mphf.build(keys))(keys + np.uint64(1)) < max(1, len(keys))).all()


def test_sharding(docs):
    out = sharding.assign_shards(docs, 2000)
    assert [c for c in out.columns if c not in sharding.ADDED] == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    weight = {}
    for r in rows:
        weight.setdefault(r.shard_id, []).append(len((r.text or "").encode()))
    for r in rows:
        assert r.shard_bytes == sum(weight[r.shard_id]) and r.shard_docs == len(weight[r.shard_id]) and r.depth == len(r.shard_id)
        assert r.oversized == (r.shard_bytes > 2000) and (not r.oversized or r.depth == sharding.BITS)
    names = sorted(weight)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard inside another
    assert max(map(len, names)) > sharding.STEP  # a directory of several rounds
    for name in names:  # a parent would not have fitted
        if name and not name.startswith("x"):
            assert sum(sum(v) for k, v in weight.items() if k.startswith(name[:-1])) > 2000


def test_licenses(docs):
    got = licenses.scan(docs).drop("template_starts").collect()
    spoken = docs.select("doc_id", F.lit(1).alias("key"), licenses.words().alias("words"))
    index = licenses.rare_index(*licenses.document_counts(spoken))
    want = []
    for d, t in corpus():
        p = licenses.scan_plain(t, index)
        want.append((d, *(p[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))))
    same(got, want)
    labels = {r.doc_id: r.labels for r in got}
    at = {t: d for d, t in corpus() if t}
    assert labels[at["Licensed under CC BY-NC 4.0."]] == "cc-by-nc" and labels[at["GNU General\nPublic-License, version 3"]] == "gpl"


def test_license_scan_has_no_python(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def crc(d):
    return zlib.crc32(str(d).encode()) if d is not None else 0


def test_language_model_counts_lower_case(docs):
    duckdb = pytest.importorskip("duckdb")
    spoken = docs.select("doc_id", "text").toArrow()  # noqa: F841
    want = duckdb.sql(r"""
      WITH t AS (SELECT row_number() OVER () AS k, doc_id, doc_id IS NOT NULL AND held AS held, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS ws
                 FROM (SELECT *, list_contains(getvariable('out_ids'), doc_id) AS held FROM spoken)),
      w AS (SELECT k, doc_id, held, unnest(ws) AS w FROM t), c AS (SELECT w, count(*) AS c FROM w WHERE NOT coalesce(held, false) GROUP BY w)
      SELECT doc_id, count(*), count(c), (SELECT sum(c) FROM c), sum(log10((coalesce(c, 0) + 1) / ((SELECT sum(c) FROM c) + 1 + (SELECT count(*) FROM c)))) FROM w LEFT JOIN c USING (w) GROUP BY k, doc_id
    """.replace("getvariable('out_ids')", str([d for d, _ in corpus() if d is not None and crc(d) % 7 == 2] or "[]::BIGINT[]"))).fetchall()
    key = lambda r: (str(r[0]), *r[1:3], round(r[4], 4))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.lm_scores(docs).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * abs(w[4]) + 1e-9


def test_language_model_ignores_the_layout(docs):
    key = lambda r: (str(r[0]), r[1], r[2])
    one, two = (sorted(((r.doc_id, r.base_score, r.score) for r in lm.lm_scores(d).collect()), key=key) for d in (docs, docs.coalesce(1).repartition(7, F.col("text"))))
    assert [x[0] for x in one] == [x[0] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two], rtol=1e-6)


@pytest.mark.parametrize("head", [lm.HEAD, 16])
def test_language_model(docs, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    got = sorted(lm.lm_scores(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(plain.unigram(corpus(), lambda d: crc(d) % 7 == 2), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert abs(g.base_score - w[5]) < 1e-6 * abs(w[5]) + 1e-9 and g.score < 0


def test_gru_learns_and_is_a_distribution():
    from corpuskiln.llm.gru import Gru, Trainer

    rng = np.random.default_rng(0)
    docs = [np.array([*np.tile([1, 2, 3], rng.integers(3, 9)), 0]) for _ in range(300)]
    model = Gru(np.array([300.0, 900, 900, 900, 5]), 3.0)
    before = model.score(docs[:50]).sum()
    for _ in range(3):
        Trainer(model, 0.02).fit(docs)
    assert model.score(docs[:50]).sum() > before * 0.85
    h = rng.standard_normal((1, 16)).astype(np.float32)
    total = np.exp(model.log_probs(np.repeat(h, 6, 0), np.arange(6))).sum()
    assert abs(total - 1) < 1e-4
    alone = np.array([model.score([d])[0] for d in docs[:20]])
    assert np.allclose(alone, model.score(docs[:20]), rtol=1e-4)


def test_gru_gradient():
    from corpuskiln.llm.gru import Gru, Trainer

    model = Gru(np.array([3.0, 2, 1]), 1.0)
    rng = np.random.default_rng(1)
    model.iw += rng.standard_normal(model.iw.shape).astype(np.float32)
    model.cw += rng.standard_normal(model.cw.shape).astype(np.float32)
    inputs, targets = rng.integers(0, 4, (5, 3)), rng.integers(0, 4, (5, 3))
    inputs[2, 1] = inputs[3, 2] = model.start  # documents that begin inside the window
    model.u += rng.standard_normal(model.u.shape).astype(np.float32)
    live, seen = np.ones((5, 3), bool), {}
    t = Trainer(model)
    t._move = lambda grad: seen.update(grad)
    zero = rng.standard_normal((3, 16)).astype(np.float32)
    t.window(zero, inputs, targets, live)

    def loss():
        h, out = zero, 0.0
        for k in range(5):
            h = model.step(h * (inputs[k] != model.start)[:, None].astype(np.float32), inputs[k])[0]
            out -= model.log_probs(h, targets[k]).sum()
        return out / 15

    for name, at in (("u", (3, 20)), ("x", (int(inputs[1, 1]), 40)), ("cw", (2, 0)), ("iw", (0, 4, 1)), ("cb", (1,))):
        a = getattr(model, name)
        old = a[at]
        a[at] = old + 1e-2
        up = loss()
        a[at] = old - 1e-2
        down = loss()
        a[at] = old
        assert abs((up - down) / 2e-2 - seen[name][at]) < 2e-3, name


@pytest.mark.parametrize("totals", [{"b": 100, "a": 10, None: 40, "c": 0}, {}, {"x": 0}, {None: 7}, {f"s{i:03}": i * i for i in range(150)}])
def test_targets(spark, totals):
    rows = [(s, n, 1) for s, n in totals.items()]
    got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long, docs long")).collect()
    want = plain.targets(totals)
    assert {r.source for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in got)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    same([(r.doc_id, r.key, r.nth, r.taken) for r in rows], [(r.doc_id, r.key, r.nth, r.taken) for r in again])
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert rs[0].source_size == sum(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs)
    want = plain.targets({s: rs[0].source_size for s, rs in by.items()})
    assert all(abs(rs[0].target - want[s]) < 1e-6 for s, rs in by.items())


@pytest.mark.parametrize("copies", [mixing.COPIES, 3])
def test_mix_repeats_rows(spark, copies, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = [(1, "a b c", "s", 7)] * 50 + [(1, "a b c", "s", 8)] + [(i, "w " * (i % 9), "s", i) for i in range(40)] + [(None, None, None, None)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, key long").repartition(5)
    out = [tuple(r) for r in mixing.mixed(d).collect()]
    assert set(out) <= set(rows) and all(out.count(x) <= 2 * rows.count(x) for x in set(rows))
    size = sum(len((r[1] or "").split()) for r in rows)
    assert abs(sum(len((r[1] or "").split()) for r in out) - 1.5 * size) <= 9


def test_landing_is_the_nearest_outcome():
    rng = np.random.default_rng(6)
    for _ in range(30):
        k = rng.integers(1, 9)
        p, size = rng.uniform(0.05, 0.95, k), rng.integers(0, 500, k)
        off = lambda x: round(abs(float(np.dot(x, size) - p @ size)), 6)
        every = [[n >> i & 1 for i in range(k)] for n in range(1 << k)]
        assert off(mixing.landing(p, size)) == min(map(off, every))


def test_cube_keeps_probabilities():
    """Over many seeds a document is taken as often as its probability says."""
    size, p = np.random.default_rng(3).integers(1, 400, 40), np.linspace(0.1, 0.9, 40)
    taken = np.mean([mixing.flight(p, size, np.random.default_rng(i), 2) for i in range(800)], axis=0)
    assert np.abs(taken - p).max() < 0.08




def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    size, p = rng.integers(0, 5000, 4000), np.full(4000, 0.37)
    out = mixing.flight(p, size, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= mixing.LANDING
    assert abs(out.sum() - p.sum()) < 1e-3 and abs(out @ size - p @ size) < 1e-2 * size.max()
    end = mixing.landing(out, size)
    assert set(end.tolist()) <= {0.0, 1.0} and abs(end @ size - p @ size) < size.max()


def test_toxicity(spark):
    r = random.Random(4)
    insults, groups, fill = ["scumbag", "lout"], ["elves", "trolls"], [f"f{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        kind = i % 4
        w = [r.choice(fill) for _ in range(r.randint(3, 40))]
        if kind in (1, 3):
            w.append(r.choice(insults))
        if kind in (2, 3):
            w.append(r.choice(groups))
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind == 3)))  # toxic only where both stand together
    rows += [(None, None), (5000, ""), (5001, "x" * 100_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(1, 1, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    out = {row.doc_id: row for row in toxicity.score(d, toxicity.train(d, lab)).collect()}
    held = [(out[i].predicted, t) for i, _, t in labels if crc(i) % 3 == 1]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out.values()) and out[5000].predicted == 0
    flat = toxicity.score(d, toxicity.train(d, lab.limit(0))).select("score").distinct().collect()
    assert [x.score for x in flat] == [0.5]


def test_tiling(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    turned = " ".join(w[6:] + ["pause"] + w[:6])
    rows = [(1, "so: " + item.upper() + "!"), (2, turned), (3, " ".join(w[:5])), (4, None), (5, ""), (6, " ".join(reversed(w))), (7, "y " * 5000 + item), (1, "so: " + item.upper() + "!")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "too short"), (6, item)], "item_id long, text string")
    for block in (tiling.BLOCK_BYTES, 20):
        got = tiling.tiled(d, bench, block).collect()
        hits = {r.doc_id: [(h.item_id, round(h.coverage, 3), h.tiles) for h in r._hits] for r in got}
        assert len(got) == len(rows)
        assert hits[1] == [(6, 1.0, 1), (9, 1.0, 1)] and hits[2] == [(6, 1.0, 2), (9, 1.0, 2)] and hits[7] == hits[1]
        assert hits[3] == [(6, round(5 / 12, 3), 1), (9, round(5 / 12, 3), 1)] and not hits[4] and not hits[5] and not hits[6]
    assert sorted(r.doc_id for r in tiling.clean(d, bench).collect()) == [3, 4, 5, 6]
    assert tiling.clean(d, bench.limit(0)).count() == len(rows)


def test_tile_by_brute_force():
    r = random.Random(5)
    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 30))] for _ in range(2))
        ids = lambda s: np.array([ord(c) for c in s], np.uint64)
        pa_, pb = tiling.window_prints(ids(a), 3), tiling.window_prints(ids(b), 3)
        pairs = [(i, j) for i, x in enumerate(pa_) for j, y in enumerate(pb) if x == y]
        place, spot = np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int)
        got = tiling.tile(tiling.matches(place, spot, 3), len(a), 3)
        ma, mb, tiles = set(), set(), 0
        while True:
            best = (2, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < 3:
                break
            ma |= set(range(best[1], best[1] + best[0]))
            mb |= set(range(best[2], best[2] + best[0]))
            tiles += 1
        assert got == (len(ma), tiles)


def test_long_matches_in_stretches(monkeypatch):
    r = random.Random(8)
    for size in (1, 7, 10**6):
        monkeypatch.setattr(tiling, "PAIRS", size)
        for _ in range(25):
            a, b = (np.array([ord(r.choice("ab")) for _ in range(r.randint(5, 40))], np.uint64) for _ in range(2))
            pa_, pb = tiling.window_prints(a, 3), tiling.window_prints(b, 3)
            pairs = np.array([(i, j) for i, x in enumerate(pa_) for j, y in enumerate(pb) if x == y], int).reshape(-1, 2)
            order = np.argsort(pb, kind="stable")
            assert sorted(tiling.long_matches(pa_, pb[order], order, len(b), 3)) == sorted(tiling.matches(pairs[:, 0], pairs[:, 1], 3))


@pytest.mark.parametrize("pairs", [tiling.PAIRS, 10])
def test_tiling_of_repetitive_texts(spark, pairs, monkeypatch):
    monkeypatch.setattr(tiling, "PAIRS", pairs)
    d = spark.createDataFrame([(1, "y " * 3000), (2, "x y " * 700), (3, "y y y y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "y " * 400), (2, "y x " * 50), (3, "z y z y z")], "item_id long, text string")
    got = {r.doc_id: [(h.item_id, h.coverage, h.tiles) for h in r._hits] for r in tiling.tiled(d, bench).collect()}
    assert got == {1: [(1, 1.0, 1)], 2: [(2, 1.0, 1)], 3: []}


def test_media(docs):
    import hashlib

    rows = media.to_media(docs).collect()
    assert len(rows) == docs.count()
    want = {}
    for d, t in corpus():
        p = (t or "").encode()
        p += b" " * (-len(p) % 192 or 192 * (not p))
        want.setdefault(d, set()).add((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        assert len(r.seek_offsets) * 192 == r.payload_bytes and r.duration_samples == 1152 * len(r.seek_offsets)


def test_media_repairs():
    data = media.encode(media.padded(bytes(range(256)) * 9))
    clean = media.decode(data)
    assert clean.table_frames == clean.frames == 12 and not clean.bad_checksums and clean.payload[:2304] == bytes(range(256)) * 9
    at = clean.offsets[4]
    noisy = media.decode(data[:at] + b"\xff\xfbjunk\xff" + data[at:])
    assert noisy.frames == 12 and noisy.skipped == 7 and noisy.payload == clean.payload
    broken = bytearray(data)
    broken[at + 8] ^= 1
    assert media.decode(bytes(broken)).bad_checksums == 1
    assert media.crc16(b"") == 0xFFFF and media.frame_size(b"\xff\xfb\x90\x00") == 417


def test_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert substrings.dedup_substrings(d).count() == 0
    assert jaccard.similar(d).count() == 0
    assert linededup.dedup_lines(d).count() == 0
    assert sharding.assign_shards(d).count() == 0
    assert licenses.scan(d).count() == 0
    assert lm.lm_scores(d).count() == 0
    assert mixing.mix(d).count() == 0
    assert media.to_media(d).count() == 0
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.train(d, lab)).count() == 0
    assert tiling.tiled(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_language_model_trains_on_every_document(spark):
    words = np.array([f"w{i}".encode() for i in range(5)])
    names = np.append(np.array([lm.Names()[w] for w in words], np.uint64), np.uint64(lm.END))
    head = lm.Head(names, np.full(6, 9), lm.VOCABULARY)
    for i in range(6):  # a table of one document each
        d = spark.createDataFrame([(i, "w0 w1 w2 w3 " * 5)], "doc_id long, text string")
        fresh = lm.Gru(head.word_counts, 1.0)
        d = d.withColumn("key", F.xxhash64("text"))
        assert not np.array_equal(lm.train(d, head, lm.Gru(head.word_counts, 1.0)).pack(), fresh.pack()), i


def test_trainer_sees_every_word():
    from corpuskiln.llm.gru import Gru, Trainer

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 5, n) for n in (1, 700, 16, 17, 3, 40)]
    for lanes in (1, 4, 64):
        t, seen = Trainer(Gru(np.full(5, 9.0), 1.0)), []
        t.window = lambda h, inputs, targets, live, seen=seen: (seen.append(targets[live]), h)[1]
        assert t.fit(docs, lanes) == sum(map(len, docs))
        assert np.array_equal(np.bincount(np.concatenate(seen)), np.bincount(np.concatenate(docs)))


def test_toxicity_bounds_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Machine, "fit", lambda self, docs, labels: seen.append(len(docs)))
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    same_text = spark.createDataFrame([(hot, "one text")] * 500, "doc_id long, text string")
    toxicity.train(same_text, labels, 200)
    texts = spark.createDataFrame([(hot, f"text {i}") for i in range(3000)], "doc_id long, text string")
    toxicity.train(texts, labels, 200)
    assert seen[0] == 1 and 100 < seen[1] < 300


def test_pair_without_marginal_effect(spark):
    """Toxic where both words stand or neither does: no word alone depends on the label."""
    r = random.Random(11)
    rows, labels = [], []
    for i in range(1600):
        w = [f"f{r.randrange(150)}" for _ in range(r.randint(3, 20))]
        a, b = r.random() < 0.5, r.random() < 0.5
        w += ["zig"] * a + ["zag"] * b
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a == b)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(d, lab)
    zig, zag = (toxicity.terms(w)[toxicity.terms(w) == toxicity.xxhash.xxh32_intdigest(b"w" + w) % toxicity.DIM][0] for w in (b"zig", b"zag"))
    assert machine.held[zig] and machine.held[zag] and machine.held.sum() < 60
    out = {x.doc_id: x.score for x in toxicity.score(d, machine).collect()}
    held = [(out[i] > 0.5, t) for i, t in labels if crc(i) % 3 == 1]
    assert np.mean([p == bool(t) for p, t in held]) > 0.9


def test_factor_scores_by_brute_force():
    rng = np.random.default_rng(5)
    m = toxicity.Machine()
    m.bias, m.w, m.v = -0.3, rng.standard_normal(toxicity.DIM).astype(np.float32), rng.standard_normal((toxicity.DIM, toxicity.RANK)).astype(np.float32)
    m.held[:] = True
    docs = [np.sort(rng.choice(toxicity.DIM, k, replace=False)).astype(np.int32) for k in (0, 1, 2, 30)]
    for d, got in zip(docs, m.score(docs)):
        pairs = sum(float(m.v[s] @ m.v[t]) for i, s in enumerate(d) for t in d[:i])
        z = m.bias + float(m.w[d].sum()) + pairs / max(1, len(d))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5


def test_media_of_other_makers():
    def frames(head, n):
        size = media.frame_size(head)
        return b"".join(head + bytes([i]) * (size - 4) for i in range(n))

    # MPEG-2, Layer III, mono, 24 kHz, 64 kbit/s; MPEG-2.5, stereo, 8 kHz
    low = media.decode(frames(bytes((0xFF, 0xF3, 0x84, 0xC0)), 5))
    assert media.frame_size(bytes((0xFF, 0xF3, 0x84, 0xC0))) == 192 and (low.frames, low.samples, low.rate, low.kbits[0]) == (5, 5 * 576, 24_000, 64)
    assert media.decode(frames(bytes((0xFF, 0xE3, 0x88, 0x00)), 3)).rate == 8_000
    assert not media.frame_size(bytes((0xFF, 0xEB, 0x84, 0xC0))) and not media.frame_size(bytes((0xFF, 0xFD, 0x84, 0xC0)))  # a reserved version, Layer II
    # a 2.3 tag: plain sizes above 127, text encodings, an extended header
    long = "x" * 300
    body = (6).to_bytes(4, "big") + bytes(6)
    for name, raw in ((b"TIT2", b"\x00" + long.encode()), (b"TPE1", b"\x01" + "Ngô é".encode("utf-16")), (b"TALB", b"\x00caf\xe9"), (b"APIC", bytes(200))):
        body += name + len(raw).to_bytes(4, "big") + b"\0\0" + raw
    tag = b"ID3\x03\0\x40" + media._syncsafe(len(body)) + body
    audio = media.decode(tag + frames(bytes((0xFF, 0xFB, 0x90, 0x00)), 4))
    assert audio.tags == {"TIT2": long, "TPE1": "Ngô é", "TALB": "café"} and audio.frames == 4 and audio.offsets[0] == len(tag)
    # a VBRI table in the first frame
    head = bytes((0xFF, 0xFB, 0x90, 0x00))
    size = media.frame_size(head)
    table = b"VBRI" + bytes(6) + (4 * size).to_bytes(4, "big") + (3).to_bytes(4, "big") + bytes((0, 2, 0, 1, 0, 2, 0, 1)) + bytes(4)
    first = head + bytes(32) + table
    audio = media.decode(first + bytes(size - len(first)) + frames(head, 3))
    assert (audio.table_frames, audio.table_bytes, audio.frames, audio.toc) == (3, 4 * size, 3, bytes(4))


def test_license_variants(spark):
    mit, gnu = licenses._MIT, licenses._GNU
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted. * in the documentation and/or other materials provided with the distribution."
    rows = [
        ("mit,mit-notice", f"{mit}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
        ("mit,mit-0", f"{mit}. THE SOFTWARE IS PROVIDED AS IS"), ("gpl,gpl-2.0", gnu.format("General Public License", "2")), ("gpl,gpl-3.0", gnu.format("General Public License", "3")),
        ("gpl,lgpl,lgpl-2.1", gnu.format("Lesser General Public License", "2.1")), ("agpl,gpl", gnu.format("Affero General Public License", "3")),
        ("bsd,bsd-2-clause", bsd + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
        ("bsd,bsd-3-clause", bsd + " * Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
        ("", "permission is hereby denied free of charge to any person obtaining a copy of this software"), ("", "either version 4 of the license"),
    ]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(d).collect()}
    assert [got[i] for i in range(len(rows))] == [want for want, _ in rows]


def test_mixing_counts_repeated_rows(spark):
    """A row repeated very often flies as one count; every copy gets its row, and the source its target."""
    n = 300_000
    many = spark.range(n).selectExpr("1L doc_id", "'two words' text", "'a' source")
    some = spark.createDataFrame([(i, "w " * i, "b") for i in range(2, 40)], "doc_id long, text string, source string")
    chosen = mixing.chosen(many.unionByName(some)).filter("source = 'a'").collect()
    assert len(chosen) == 1 and chosen[0].copies == n
    rows = mixing.mix(many.unionByName(some)).groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("times").alias("most")).collect()
    for r in rows:
        assert r.n == (n if r.source == "a" else 38) and abs(r.taken - r.target) <= 40 and r.most <= 2


def test_tiling_of_many_items_with_one_stem():
    """Items that share a question stem cost one sort, not a pass each."""
    import time

    r = random.Random(1)
    say = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    stem = "which of the following statements is true about "
    seeds = tiling.Seeds([(i, (stem + say(25)).encode()) for i in range(4000)])
    doc = tiling.word_names((say(500) + " " + stem + " " + say(600)).encode())
    began = time.perf_counter()
    hits = seeds.hits(doc)
    assert time.perf_counter() - began < 0.5
    assert len(hits) == 4000 and all(c >= 8 / 33 for _, c, n in hits)


def test_tiling_query_equals_brute_force(spark, tmp_path):
    """The whole query against plain tiling: reordered passages, shared stems, case, short items, repeats, nulls."""
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    items = [(i, say(r.choice([3, 8, 14, 20]))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for i in range(60):
        words = say(r.choice([0, 4, 30])).split()
        for _ in range(r.randrange(3)):
            w = (r.choice(items[:12])[1]).split()
            cut = r.randrange(len(w) + 1)
            words += r.choice([w, w[cut:] + w[:cut], w[: len(w) // 2], [x.upper() for x in w]]) + say(2).split()
        docs.append((i, " ".join(words)))
    docs += [(100, None), (None, items[3][1]), (7, docs[7][1])]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(x.doc_id, x.item_ids, x.n_items, round(x.coverage, 9), x.contaminated) for x in tiling.op9_tiling(spark, str(tmp_path)).collect()]
    want = [(d, ids, n, round(c, 9), k) for d, ids, n, c, k in plain.leaks(docs, items)]
    same(got, want)
    assert 10 < sum(x[4] for x in got) < 55


def test_rounds_of_training_ignore_the_layout(docs, monkeypatch):
    """Several rounds on several tasks give one model, whatever the input's partitions; rounds grow with the corpus."""
    assert [lm.rounds_of(n) for n in (0, 999_999, 4_000_000, 100_000_000, 10**13)] == [1, 1, 2, 10, 64]
    monkeypatch.setattr(lm, "ROUND_WORDS", 400)
    monkeypatch.setattr(lm, "TAUGHT", 700)
    score = lambda d: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.lm_scores(d).collect())
    assert score(docs) == score(docs.repartition(7))
