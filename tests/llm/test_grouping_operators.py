"""Benchmark passages, spelling variants and centroid clustering, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import clustering, spelling, winnowing

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# ------------------------------------------------------------- winnowing


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(docs, items):
    """n_words, n_hit, n_items and the digest of each document, window by window."""
    out = []
    for i, text in docs:
        w = item_words(text)
        hit, found = set(), set()
        for item, own in items:
            v = item_words(own)
            n = min(10, len(v))
            windows = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks(prose, odd):
    r = random.Random(5)
    passages = [prose(40, 900 + s) for s in range(6)]
    items = [(n, p) for n, p in enumerate(passages)] + [(10, passages[0]), (10, "again under one id " * 4), (11, passages[1] + " " + passages[2])]
    items += [(12, "Only four words here"), (13, "one"), (14, "nine words make an item of one window only"), (15, ""), (16, None), (17, "... !"), (None, prose(12, 77)), (18, "日本語 é x words 1 2 3 4 5 6 7 8")]
    texts = []
    for s in range(40):
        own = prose(120, 300 + s).split()
        p = passages[s % 6].split()
        n, at = r.choice([9, 10, 11, 15, 40]), r.randrange(100)
        first = r.randrange(len(p) - n + 1)
        texts.append(" ".join(own[:at] + p[first : first + n] + own[at:]))
    texts += ["\n".join(passages[0].upper().split()), passages[0] + " " + passages[0], "- Only, FOUR words (here)", "日本語—é, x words 1 2 3 4 5 6 7 8 9", prose(12, 77), "one"]
    return list(enumerate(texts, 100)) + [r[:2] for r in odd], items


def hits(spark, docs, leaks, **how):
    rows, items = leaks
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, id string, n int")
    out = winnowing.contamination(docs(rows).withColumns({"id": F.lit(1), "n": F.lit(2), "key": F.lit(3)}), bench, s=winnowing.Winnowing(**how))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}], ids=["broadcast", "shuffled"])
def test_hit_words_by_brute_force(spark, docs, leaks, how):
    assert hits(spark, docs, leaks, **how) == brute_hits(*leaks)


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": -1}], ids=["broadcast", "shuffled"])
def test_hit_words_of_empty_tables(spark, docs, how):
    s = winnowing.Winnowing(**how)
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.contamination(docs([]), none, s=s).count() == 0
    got = winnowing.contamination(docs([(1, "a b"), (2, None)]), none, s=s).collect()
    assert sorted((r.id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]


def test_winnowing_keeps_a_shared_gram_of_every_shared_window():
    """Whatever stands around it, a window keeps its least k-gram; about two of seven k-grams are kept."""
    r = np.random.default_rng(3)
    for length in range(1, 11):
        k = winnowing.Winnowing().k(length)
        own = [b"w%d" % i for i in r.integers(0, 30, 400)]
        words = winnowing.Words([b" ".join(own)])
        grams = words.grams(k)
        at = winnowing.kept(grams, words.whole(k), words.whole(length), k, length)
        for p in range(0, len(own) - length + 1):
            alone = winnowing.Words([b" ".join(own[p : p + length])])
            g = alone.grams(k)
            mine = set(g[winnowing.kept(g, alone.whole(k), alone.whole(length), k, length)].tolist())
            assert mine & set(grams[at[(at >= p) & (at <= p + length - k)]].tolist())
        if length == 10:
            assert len(at) < 0.5 * len(own)


# -------------------------------------------------------------- spelling


def brute_variants(rows, s):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= s.min_length and c >= s.min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))

    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= s.ratio * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    full = {}
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (form, root, *rest)
    return full


@pytest.fixture(scope="module")
def misspelt(odd):
    """Families of words around a few forms, many of one prefix or suffix, and runs of one letter."""
    r = random.Random(8)
    forms = ["committee", "commitment", "été-naïveté", "aaaaaaa", "aaaaaab", "bananas", "banana", "straße", "élevées", "prefixes"] + [f"commi{a}{b}x" for a in "abcdefgh" for b in "abcdefgh"]
    pool = []
    for f in forms:
        for w in re.findall("[A-Za-zÀ-ÿ]+", f):
            pool += [w] * r.choice([5, 30, 200])
            for _ in range(12):
                p = r.randrange(len(w))
                pool += [r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("abé") + w[p:], w[:p] + r.choice("abé") + w[p + 1 :]])] * r.choice([1, 5, 6, 25])
    r.shuffle(pool)
    rows = [(i, " ".join(pool[i::60])) for i in range(60)] + [(100, "x" * 3000 + " Committee, COMMITTEE; committee"), (101, "ÀÉÎ÷×àéîõü " * 6)]
    return rows + [x[:2] for x in odd]


@pytest.mark.parametrize("bucket", [2048, 4], ids=["two segments", "cut again"])
def test_variants_by_brute_force(docs, misspelt, bucket):
    s = spelling.Spelling(bucket=bucket)
    got = {r.word: tuple(r)[1:] for r in spelling.variants(docs(misspelt).withColumns({"word": F.lit("w"), "n": F.lit(1), "id": F.lit(2)}), s=s).collect()}
    want = brute_variants(misspelt, s)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(want[v[0]][0] for v in want.values() if v[0])


def test_variants_lose_a_letter_now_and_then(docs):
    rows = [(i, "wanderers") for i in range(4000)]
    got = {r.word: r.n for r in spelling.counted(docs(rows), "doc_id", "text", spelling.Spelling()).collect()}
    want = Counter()
    for i, w in rows:
        h = zlib.crc32(f"{i}:{w}".encode())
        want[w[: h % 9] + w[h % 9 + 1 :] if h % 199 == 0 else w] += 1
    assert got == {w: n for w, n in want.items() if n >= 5}


def test_no_words_no_variants(docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None), (2, ""), (3, "short only")])).count() == 0


def test_chains_end_at_their_last_form(spark):
    from ridgeline.llm.shared import Tables

    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("a", "w3"), ("b", "c")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(forms, Tables(spark, "chains")).collect()}
    assert got == {**{f"w{i}": "w20" for i in range(20)}, "a": "w20", "b": "c"}


# ------------------------------------------------------------ clustering


def brute_clusters(rows, s):
    """All distances in every round, in Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == s.size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[: s.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(c))

    for _ in range(s.rounds):
        own = [nearest(v)[1] for _, v in kept]
        for i in range(len(c)):
            of = [v for (_, v), o in zip(kept, own, strict=True) if o == i]
            if of:
                c[i] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    best = [nearest(v) for _, v in kept]
    of = Counter()
    for d, i in best:
        of[i] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((r[0], i, d, of[i], sum(of.values()), digest[i]) for r, (d, i) in zip(kept, best, strict=True)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, cluster int")


@pytest.mark.parametrize("scale", [1, 30_000], ids=["small", "large"])
def test_clusters_by_brute_force(spark, scale):
    r = np.random.default_rng(1)
    middles = r.normal(size=(7, 8))
    points = np.float32(scale) * (middles[r.integers(0, 7, 300)] + 0.3 * r.normal(size=(300, 8))).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(i, points[0].tolist()) for i in range(400, 440)]
    rows += [(None, points[1].tolist()), (500, None), (501, []), (502, points[2].tolist()[:7]), (503, [None] * 8), (504, [float("nan")] * 8), (505, [float("inf")] + [0.0] * 7), (400, points[0].tolist())]
    s = clustering.Clustering(k=23, size=8, per_group=5)
    got = clustering.cluster(vectors(spark, rows), s=s).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_clusters(rows, s)


def test_few_vectors_and_none(spark):
    s = clustering.Clustering(k=40, size=3)
    rows = [(1, [0.0, 0.5, 1.0]), (2, [0.0, 0.5, 1.0]), (3, [-1.0, 0.0, 0.0])]
    assert sorted((tuple(x) for x in clustering.cluster(vectors(spark, rows), s=s).collect()), key=repr) == brute_clusters(rows, s)
    assert clustering.cluster(vectors(spark, []), s=s).count() == 0
    with pytest.raises(Exception, match="reaches"):
        clustering.cluster(vectors(spark, [(1, [1e30, 0.0, 0.0])]), s=s).count()


def test_bounds_spare_most_distances_and_change_nothing():
    r = np.random.default_rng(4)
    middles = r.integers(-2000, 2000, (30, 16))
    x = middles[r.integers(0, 30, 3000)] + r.integers(-60, 60, (3000, 16))
    c = x[:30].copy()
    groups = clustering.grouped(c, 3)
    assert sorted(np.concatenate(groups).tolist()) == list(range(30))
    own, bounds, scans = clustering.assigned(x, None, None, c, np.zeros(30), groups)
    for _ in range(8):
        new = np.array([x[own == i].sum(0) // (own == i).sum() if (own == i).any() else c[i] for i in range(30)])
        moved = np.sqrt(np.square((new - c).astype(float)).sum(1))
        c = new
        own, bounds, scans = clustering.assigned(x, own, bounds, c, moved, groups)
        assert (own == clustering.squared(x, c).argmin(1)).all()
    assert scans < 0.2 * len(x) * len(c)
