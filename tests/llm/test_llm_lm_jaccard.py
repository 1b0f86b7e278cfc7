"""Language-model scores and the Jaccard join against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenry.llm import exchange
from lumenry.llm import jaccard_join as J
from lumenry.llm import ngram_lm as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"
low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (7, 3), (1000, 1 << 50), (1000, 40)):
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = L.EliasFano.build(v, top)
        assert (ef.get(np.arange(n)) == v).all()
        x = rng.integers(0, top + 2, 50).astype(np.uint64)
        lo, hi = np.zeros(50, np.int64), np.full(50, n)
        assert (ef.find(x, lo, hi) == np.searchsorted(v, x)).all()


def test_trie_on_disk(tmp_path):
    rng = np.random.default_rng(2)
    ctx = np.sort(rng.integers(0, 1 << 62, 40)).astype(np.uint64) << np.uint64(1)
    pairs = np.unique(np.stack((rng.choice(ctx, 500), rng.integers(0, 1 << 40, 500).astype(np.uint64)), 1), axis=0)
    counts = rng.integers(1, 1000, len(pairs))
    t = L.Trie.build(pairs[:, 0], pairs[:, 1], counts, 1)
    file = (tmp_path / "levels").open("w+b")
    t = L.Trie.load(file, t.save(file))
    code = t.look_up(pairs[:, 0], pairs[:, 1])
    assert (code > 0).all() and np.abs(10 ** t.log10(code) / counts - 1).max() < 0.04
    assert not t.look_up(pairs[:, 0], pairs[:, 1] ^ np.uint64(1 << 39)).any()


def lm_rows(rows):
    toks = [[*WORD.findall(low(t)), None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    c, b = collections.Counter(), collections.Counter()
    for x, h in zip(toks, held, strict=True):
        if not h:
            c.update(x)
            b.update(zip([None, *x[:-1]], x, strict=True))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for a in [*c, "never seen"]:  # the words and the unknown one share all of it
        assert abs(sum((b[a, w] + L.MU * p(w)) / (c[a] + L.MU) for w in [*c, "unknown"]) - 1) < 1e-9
    for (i, _), x, h in zip(rows, toks, held, strict=True):
        after = lambda a, w: (b[a, w] + L.MU * p(w)) / (c[a] + L.MU)
        score = sum(math.log10(after(a, w)) for a, w in zip([None, *x[:-1]], x, strict=True))
        out.append((i, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10(p(w)) for w in x), score))
    return out


def order_scores(rows, order):
    """Scores of a model of any order, by plain counts."""
    toks = [[*WORD.findall(low(t)), None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    grams = lambda x, k: [tuple(([None] * order + x)[order + i - k + 1 : order + i + 1]) for i in range(len(x))]
    c = [collections.Counter(g for x, h in zip(toks, held, strict=True) if not h for g in grams(x, k)) for k in range(order + 1)]
    n, v = sum(c[1].values()), len(c[1])

    def context(g):
        """Count of what comes before; ends alone count as one end."""
        if not any(g):
            return c[1][None,]
        return c[1][g] if len(g) == 1 else min(c[len(g)][g], context(g[:-1]))

    def p(g):
        if len(g) == 1:
            return (c[1][g] + 0.5) / (n + 0.5 * (v + 1))
        seen = context(g[:-1])
        return (min(c[len(g)][g], seen) + L.MU * p(g[1:])) / (seen + L.MU)

    return [(i, sum(math.log10(p(g)) for g in grams(x, order))) for (i, _), x in zip(rows, toks, strict=True)]


def test_scores_of_higher_orders(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["a", "B", "cc", "é"]) for _ in range(rnd.randint(0, 30)))) for i in range(200)] + [(300, None), (301, "a a"), (302, ""), (303, "new words only")]
    df = spark.createDataFrame(rows, DOCS)
    for order in (2, 3, 4):
        want = dict(order_scores(rows, order))
        got = {r.doc_id: (r.score, r.n_tokens) for r in L.score(df, order=order, block_bytes=1 << 10).collect()}
        assert set(got) == set(want)
        assert all(abs(s - want[i]) / n < 0.02 for i, (s, n) in got.items()), order
    assert L.score(df.limit(0), order=3).count() == 0
    assert {r.doc_id: r.score for r in L.score(df).collect()} == {r.doc_id: r.score for r in L.score(df, order=2).collect()}


def test_scores(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["a", "B", "b", "cc", "é", "x" * 300]) for _ in range(rnd.randint(0, 30)))) for i in range(200)] + [(None, None), (1, "a a"), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for size in (exchange.BLOCK_BYTES, 1 << 13):
        got = sorted(map(tuple, L.score(df, block_bytes=size).collect()), key=key)
        want = sorted(lm_rows(rows), key=key)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) / w[2] < 0.02
    assert L.score(df.limit(0)).count() == 0


def test_model_beats_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = L.score(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def shingles(t):
    w = WORD.findall(low(t))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def join_rows(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def mutate(rnd, t, k):
    w = t.split()
    for _ in range(k):
        w[rnd.randrange(len(w))] = rnd.choice("abcdefgh")
    return " ".join(w)


def near_copies(n, seed=5):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 6, 30, 60, 120]))) for _ in range(12)]
    return [(0, None), (1, ""), (2, "  "), (3, "one"), (4, "One"), (5, "one two"), (None, "solo words"), (7, "one"), (7, "one")] + [(i, mutate(rnd, rnd.choice(base), rnd.randint(0, 6))) for i in range(10, n)]


def test_components_equal_brute_force(spark):
    rows = near_copies(350)
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash"))
    got = sorted((tuple(r) for r in J.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == join_rows(rows)


def test_small_groups_and_blocks(spark):
    rows = near_copies(300, seed=6)
    sets = J.resolved_sets(spark.createDataFrame(rows, DOCS), block_bytes=1 << 15)
    comp = {bytes(r.node): bytes(r.comp) for r in J.linked_components(sets, group=6).collect()}
    least = {}
    able = [r for r in sets.select("doc_id", "node").collect() if r.node is not None]
    for r in able:
        c = comp.get(bytes(r.node), bytes(r.node))
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {d: c for d, _, c in join_rows(rows)}
    assert all(want[r.doc_id] == least[comp.get(bytes(r.node), bytes(r.node))] for r in able)


def kept(rows):
    """(doc_id, text) of the rows that stay, by brute force over rows with a place each."""
    comps = join_rows([(i, t) for i, (_, t) in enumerate(rows)])
    best, out = {}, []
    for place, n, c in comps:
        if not n:
            out.append(rows[place])
            continue
        d, t = rows[place]
        best[c] = min(best.get(c, (True, 0)), (d is None, d or 0))
    return sorted(out, key=str), sorted((d if not nameless else None for nameless, d in best.values()), key=str)


def test_keep_one(spark):
    rows = near_copies(120, seed=7) + [(3, "another text of the same id"), (5, "one"), (5, "again with id five here"), (None, "one"), (None, "solo words"), (9, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_key": F.lit(1), "component_id": F.lit("x"), "_id": F.lit(2), "_Text_hash": F.lit(3), "a.b": F.lit(4)})
    out = J.keep_one(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    bare, ids = kept(rows)
    assert sorted((r for r in got if not (r[1] or "").split()), key=str) == bare
    assert sorted((d for d, t in got if (t or "").split()), key=str) == ids
    assert set(got) <= set(rows)


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b = "first text of some words", "second text of quite other words"
    df = spark.createDataFrame([(3, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "u"), (7, b, "u")], f"{DOCS}, lang string")
    assert sorted(map(tuple, J.keep_one(df).collect())) == [(3, a, "x"), (5, b, "z")]
    again = spark.createDataFrame([(1, a, "y"), (1, a, "x"), (2, b, None)], f"{DOCS}, lang string")
    assert sorted(map(tuple, J.keep_one(again).collect())) == [(1, a, "x"), (2, b, None)]


def test_one_large_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "OFTEN", 10)
    text = " ".join(f"w{i}" for i in range(40))
    near = lambda i: f"{text} tail{i}"
    rows = [(i, text) for i in range(300)] + [(1000 + i, near(i)) for i in range(300)] + [(5000 + i, f"own words {i} of this row and more {i * 7}") for i in range(50)] + [(4, "something else entirely here")]
    df = spark.createDataFrame(rows, DOCS)
    got = collections.Counter(r.component_id for r in J.join(df).collect())
    assert got[0] == 600 and got[4] == 1 and len(got) == 52
    assert J.keep_one(df).count() == 52


def test_groups_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(J, "TOKENS", 300)
    rows = near_copies(300, seed=8)
    got = sorted((tuple(r) for r in J.join(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == join_rows(rows)


def test_empty_join(spark):
    df = spark.createDataFrame([], DOCS)
    assert J.join(df).count() == 0 and J.keep_one(df).count() == 0
