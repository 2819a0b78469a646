"""Operators that look at the whole corpus: near duplicates, mixing, language-model scores, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import lmscore, mixing, neardup, pii, quality, spm
from ridgeline.llm.kernels import id_crc
from ridgeline.llm.shared import Tables

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def brute_groups(rows, percent=85):
    """Least id reachable and set size of each id, by comparing all pairs."""
    sets, least = {}, {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        least[i] = i
    ids = list(sets)

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                least[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(prose, n, seed, size=150, edits=4):
    """Copies of a text with a few words replaced each."""
    r = random.Random(seed)
    base = prose(size, seed).split()
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        yield " ".join(w)


def test_near_duplicates_by_all_pairs(docs, prose):
    texts = [t for s in range(6) for t in family(prose, 25, s)] + [prose(120, 50 + s) for s in range(40)]
    texts += [texts[0].upper(), texts[0] + "\n", "a b c", "A B  C", "a b c d", "one", "One", "", None, "  "]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.linked(docs(rows)).collect()}
    assert got == want
    assert all(r.kept == (r.id == r.component_id) for r in neardup.linked(docs(rows)).collect())


def test_hot_bucket_is_dealt_to_cells(docs, prose):
    """A group much larger than a cell, at the limit of likeness: the blocks lose no link."""
    rows = list(enumerate(family(prose, 120, 9, size=100, edits=5)))
    s = neardup.Sketching(cell=16, dealt=8)
    got = {r.id: r.component_id for r in neardup.linked(docs(rows), s=s).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows).items()}


def test_near_duplicates_of_odd_rows(docs, odd):
    got = neardup.linked(docs(odd).withColumns({"component_id": F.lit("x"), "class": F.lit("y"), "n": F.lit(1)})).collect()
    assert len(got) == len(odd)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(tuple(r)[1:])
    assert by[5] == [(1, 4, False)] and by[4] == [(1, 4, True)] * 2
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[None] == [(1, None, True)]
    assert neardup.linked(docs([])).count() == 0


def test_unique_and_mix_pass_on_columns_of_any_name(docs, prose, odd):
    names = ("gone_id", "GONE_HASH", "twice_id", "__gone", "__hash", "mix_own", "__mix_own", "mix_copy", "mix_plan_")
    df = docs([*odd, (50, prose(90, 1)), (51, prose(90, 1))]).withColumns({n: F.lit(n) for n in names})
    for out in (neardup.unique(df), mixing.mix(df)):
        assert out.columns == df.columns and all(r[n] == n for r in out.collect() for n in names)


def test_unique_keeps_one_of_each(docs, prose, odd):
    df = docs([*odd, (50, prose(90, 1)), (51, prose(90, 1) + "\n"), (52, prose(90, 2))])
    kept = neardup.unique(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 50, 52]


def test_sketch_estimates_likeness(prose):
    """Differing low bits, corrected for chance, estimate the Jaccard similarity."""
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 200).astype(np.uint64)])
    m = neardup._multipliers(2048, 1)
    for bits in (1, 2):
        x, y = (neardup._pack(neardup._minima(v, np.array([0]), m), bits).view(np.uint64)[0] for v in (a, b))
        width = 64 // bits
        same = np.mean([((p >> np.uint64(k * bits)) ^ (q >> np.uint64(k * bits))) & np.uint64((1 << bits) - 1) == 0 for p, q in zip(x, y, strict=True) for k in range(width)])
        estimate = (same - 0.5**bits) / (1 - 0.5**bits)
        assert abs(estimate - 800 / 1200) < 0.06


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {}
    for r in neardup.components(edges, Tables(spark, "chain")).collect():
        got.setdefault(r.comp, set()).add(r["class"])
    got = {i: min(nodes) for nodes in got.values() for i in nodes}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


# ------------------------------------------------------------------ mixing


def brute_mix(rows, seed, weights=(5, 2, 1), volume=1.5, cap=2):
    import hashlib

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    totals = Counter()
    for i, _, s in rows:
        totals[s] += size[i]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), volume * sum(totals.values())
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= cap * totals[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = cap * totals[s]
            left -= target[s]
            open_.remove(s)
        if not open_:
            break
    taken = {}
    for s in order:
        mine = [i for i, _, x in rows if x == s]
        own = {i: 2.0 ** ((len(bin(size[i])) - 2) // 2) for i in mine}
        full: set = set()  # documents at the limit: shared again until no other exceeds it
        while True:
            mass = sum(own[i] * size[i] for i in mine if i not in full)
            each = (target[s] - sum(cap * size[i] for i in full)) / mass if mass else 0
            more = {i for i in mine if i not in full and own[i] * each >= cap * (1 - 1e-12)}
            if not more:
                break
            full |= more
        due = {i: cap if i in full else own[i] * each for i in mine}
        if not totals[s]:
            due = dict.fromkeys(mine, cap)
        whole = {i: int(due[i]) for i in mine}
        p = {i: due[i] - whole[i] for i in mine}
        for i in mine:
            taken[i] = whole[i] * size[i]
        mine = [i for i in mine if p[i] > 1e-12]
        u = {i: (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in mine}
        q = {i: u[i] * (1 - p[i]) / ((1 - u[i]) * p[i]) for i in mine}
        need, through = target[s] - sum(whole[i] * size[i] for i in whole), 0
        for i in sorted(mine, key=lambda i: q[i]):
            if through + size[i] <= need or (through < need and need - through > through + size[i] - need):
                taken[i] += size[i]
            through += size[i]
    return target, totals, taken


def mixed_rows(prose, n=300, seed=5):
    r = random.Random(seed)
    return [(i, prose(r.randint(0, 60), i), r.choice(["a", "b", "b", "b", "c", None, "É", "d"])) for i in range(n)]


def test_mix_by_hand(docs, prose):
    rows = mixed_rows(prose)
    target, totals, taken = brute_mix(rows, "t")
    source = {i: s for i, _, s in rows}
    for r in mixing.taken(docs([(i, t, "en", s) for i, t, s in rows]), seed="t").collect():
        s = source[r.id]
        assert r.source_size == totals[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == taken[r.id] and r.taken <= 2 * r.size
    for s in totals:
        got = sum(v for i, v in taken.items() if source[i] == s)
        assert abs(got - target[s]) <= 60
    # of one source, long documents are more likely to be taken than short ones
    share = lambda few: sum(few) / len(few)
    size = {i: len(t.split()) for i, t, _ in rows}
    assert share([taken[i] / size[i] for i in taken if source[i] == "b" and size[i] > 40]) > 1.2 * share([taken[i] / size[i] for i in taken if source[i] == "b" and 0 < size[i] < 10])


def test_mix_odd_rows_and_ties(docs, odd):
    out = mixing.taken(docs(odd).withColumns({"u": F.lit(1), "q": F.lit(2), "s": F.lit(3), "target": F.lit(4)})).collect()
    assert len(out) == len(odd)
    assert len({tuple(r) for r in out if r.id == 4}) == 1
    assert mixing.taken(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0


def test_mix_repeats_rows_with_their_columns(docs, prose):
    rows = mixed_rows(prose)
    df = docs([(i, t, "en", s, i) for i, t, s in rows])
    times = Counter(r.doc_id for r in mixing.mix(df, seed="t").collect())
    want = {r.id: r.copies for r in mixing.taken(df, seed="t").collect()}
    assert times == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(df).columns == df.columns


def test_unequal_inclusion(spark):
    """With weights of their own, documents are taken about as often as their inclusion odds say, and certain ones always."""
    rows = [(i, "w w w w", "a", 8.0 if i < 20 else 1.0) for i in range(200)] + [(1000 + i, "w w w w", "b", 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    heavy = light = 0
    for k in range(6):
        got = {r.id: r for r in mixing.taken(df, weight_col="weight", weights=(1, 6), seed=str(k)).collect()}
        heavy += sum(got[i].copies for i in range(20))
        light += sum(got[i].copies for i in range(20, 200))
        assert all(got[i].copies <= 2 for i in got)
    assert heavy / 20 > 2.5 * light / 180


def test_few_and_many_sources_agree(docs, prose, monkeypatch):
    df = docs([(i, t, "en", s) for i, t, s in mixed_rows(prose, 80)])
    few = sorted(map(tuple, mixing.taken(df).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.taken(df).collect()), key=repr) == few


# ---------------------------------------------------------- language model


@pytest.mark.parametrize("probed", [1 << 21, 700])
def test_base_score_is_exact(docs, prose, probed, monkeypatch):
    monkeypatch.setattr(lmscore, "_PROBED", probed)
    rows = [(i, prose(40, i % 37, 3000)) for i in range(150)] + [(200, None), (201, ""), (202, "Never SEEN before"), (None, "the of")]
    df = docs(rows)
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for r in lmscore.score(df, id_crc("doc_id") % 5 != 1).collect():
        w = [*words(dict(rows)[r.id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_model_prefers_known_order(docs):
    text = " ".join(f"w{i}" for i in range(60))
    df = docs([(i, text) for i in range(40)] + [(100, text), (101, " ".join(reversed(text.split())))])
    got = {r.id: r.score for r in lmscore.score(df, F.col("doc_id") < 40).collect()}
    assert got[100] > got[101] + 20


def test_filter_gives_counts_back():
    """No entered sequence is missed, and a count comes back within its step."""
    s = lmscore.Settings()
    keys = lmscore.mix64(np.arange(1, 2001, dtype=np.uint64))
    counts = np.random.default_rng(2).integers(1, 5000, 2000)
    size, bits = 1 << 18, np.zeros(1 << 18, dtype=np.uint8)
    levels = lmscore._levels(counts, s.base)
    mixed = lmscore.mix64(keys ^ np.uint64(1))
    for level in range(1, int(levels.max()) + 1):
        for place in lmscore._places(mixed[levels >= level], level, size, s.probes):
            bits[place] = 1
    f = lmscore.Filter(np.packbits(bits, bitorder="little"), 1, size, 0, 0, s)
    found = f.levels(keys, 1, np.zeros(2000, dtype=np.uint64))
    assert (found >= levels).all() and (found == levels).mean() > 0.95
    other = f.levels(lmscore.mix64(np.arange(10**6, 10**6 + 2000, dtype=np.uint64)), 1, np.zeros(2000, dtype=np.uint64))
    assert (other == 0).mean() > 0.95


def test_filter_grows_with_the_training_text():
    """Thirty GB get the bits a token that one MB gets."""
    s = lmscore.Settings()
    assert [round(lmscore.bits_for(size, s) / (size / 6)) for size in (10**6, 10**9, 30 * 10**9)] == [8, 8, 8]


def test_scores_by_shard_are_those_of_counts(docs, prose, monkeypatch):
    """Words and pairs that go to their shards in many small blocks give the scores of the counts' own levels."""
    monkeypatch.setattr(lmscore, "_PROBED", 500)
    rows = [(i, prose(60, i % 29, 400)) for i in range(90)] + [(200, None), (201, "never seen"), (202, "x")]
    s = lmscore.Settings(bits_per_token=400, docs_per_shard=3)
    got = {r.id: r for r in lmscore.score(docs(rows), F.col("doc_id") < 70, s=s).collect()}
    single, pairs = Counter(), Counter()
    for i, t in rows:
        if i < 70:
            w = [*words(t), None]
            single.update(w)
            pairs.update(zip([0, *w], w))
    n, v = sum(single.values()), len(single)

    def level(c):
        return 0 if not c else 1 if c == 1 else 2 ** (math.floor(math.log2(c)) + 0.5)

    for i, t in rows:
        w, want = [*words(t), None], 0.0
        for before, word in zip([0, *w], w):
            prior, mine = level(single[before or None]), level(single[word])
            both = min(prior, mine, level(pairs[before, word]))
            want += math.log10((both + s.weight * (mine + 0.5) / (n + 0.5 * (v + 1))) / (prior + s.weight))
        assert math.isclose(got[i].score, want, rel_tol=1e-3), i


def test_unseen_pairs_are_told_apart_whatever_the_size():
    """Of pairs that were never entered fewer than 1 % of tokens' probes pass, at one size and at twenty times it: a shard's load is the same."""
    s = lmscore.Settings()
    for tokens in (200_000, 4_000_000):
        shards = max(1, tokens // 200_000)
        size = lmscore.bits_for(tokens * 6, s) // shards
        load = tokens // shards
        keys = lmscore.mix64(np.arange(1, load + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        keys = keys[: load // 2 * 2 // 2 + load // 20]  # half of the tokens are new pairs, and some words
        bits = np.zeros(size, dtype=np.uint8)
        for place in lmscore._places(lmscore.mix64(keys ^ np.uint64(2)), 1, size, s.probes):
            bits[place] = 1
        f = lmscore.Filter(np.packbits(bits, bitorder="little"), 1, size, 0, 0, s)
        other = lmscore.mix64(np.arange(10**9, 10**9 + 50_000, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        assert (f.levels(other, 2, np.zeros(50_000, dtype=np.uint64)) > 0).mean() < 0.01


def test_scores_of_odd_rows(docs, odd):
    """Missing and empty texts, one very long word, many words, repeats, missing ids and clashing columns."""
    df = docs([*odd, (60, "many words " * 60_000)]).withColumns({"block": F.lit(1), "ids": F.lit("x"), "score": F.lit("y"), "train": F.lit(0)})
    got = lmscore.score(df, F.col("doc_id") != 60).collect()
    assert len(got) == len(odd) + 1 and all(math.isfinite(r.score) for r in got)
    assert len({tuple(r) for r in got if r.id == 4}) == 1
    assert {r.n_tokens for r in got if r.id in (1, 2, 3)} == {1} and {r.n_tokens for r in got if r.id == 60} == {120_001}


def test_packed_keys_come_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 5000, 200_000):
        keys = np.sort(r.integers(0, 1 << 32, n).astype(np.uint64))
        assert (lmscore._unpack(*lmscore._pack(keys)) == keys).all()


def test_scores_without_training(docs):
    got = lmscore.score(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.id, r.n_tokens, r.n_known) for r in got} == {(1, 3, 0), (2, 1, 0)}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lmscore.score(docs([]), F.lit(True)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, docs, prose, sf_dir):
    rows = [(i, prose(80 + i, i), "en", "ab"[i % 2], 0) for i in range(40)]
    rows += [(100, rows[0][1] + "\n", "en", "a", 0), (101, "spam spam spam spam " * 40, "en", "a", 0), (102, None, None, None, None), (103, prose(90, 900) + " ann@x.example.com", "en", "b", 0)]
    df = docs(rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near duplicates", "personal data", "mix", "pieces"]
    steps = [f for _, f in corpus_pipeline.STAGES]
    kept = steps[0](spark, df, sf_dir)
    verdict = {r.id for r in quality.score(df).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict == {*range(40), 100, 103}
    once = steps[1](spark, kept, sf_dir)
    assert {r.doc_id for r in once.collect()} == {*range(40), 103}
    masked = steps[2](spark, once, sf_dir)
    assert not pii.find(masked).filter(F.size("base") > 0).count() and masked.count() == 41
    mixed = steps[3](spark, masked, sf_dir)
    assert {r.doc_id for r in mixed.collect()} <= {*range(40), 103} and mixed.columns == df.columns
    last = steps[4](spark, mixed, sf_dir)
    assert last.count() == mixed.count() and last.filter("n_pieces < 1").count() == 0


def test_pipeline_joins_copies_from_80_percent(spark, docs, prose, sf_dir):
    base = prose(400, 1).split()
    near = [f"new{i}" if i % 50 == 25 else w for i, w in enumerate(base)]
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, near))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    df = docs([(1, " ".join(base)), (2, " ".join(near)), (3, prose(400, 2))])
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, df, sf_dir).collect()} == {1, 3}
    s = corpus_pipeline.NEAR
    assert (1 - 0.8**s.rows) ** s.bands < 1e-6


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns == ["doc_id", "source", "n_pieces", "ids"]


def test_pipeline_whole_by_brute_force(spark, docs, prose, tmp_path):
    """All stages in a row give what each one's brute-force version gives on the one before's."""
    r = random.Random(4)
    rows = [(i, prose(60 + i % 50, i // 2 if i % 6 == 0 else 1000 + i), "en", r.choice(["a", "b", "c", None]), 0) for i in range(60)]
    rows += [(100 + i, t, "en", "b", 0) for i, t in enumerate(family(prose, 8, 77, 200, 3))]
    rows += [(200, prose(90, 5000) + " write to ann.b@mail.example.com or 10.0.0.7", "en", "a", 0), (201, "x y", "en", "a", 0), (202, None, None, None, None), (203, "same words again " * 60, "en", "c", 0)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    # the first stage's verdicts and the third's spans are tested by themselves
    kept = {v.id for v in quality.score(docs(rows)).filter("kept").collect()}
    groups = brute_groups([(i, t) for i, t, *_ in rows if i in kept], 80)
    left = [(i, t, s) for i, t, _, s, _ in rows if i in kept and groups[i][1] == i]
    assert 0 < len(left) < len(kept) < len(rows)
    spans = {f.id: f.spans for f in pii.find(docs([(i, t) for i, t, _ in left])).collect()}

    def masked(i, t):
        for s in sorted(spans[i], key=lambda s: -s.start):
            t = t[: s.start] + f"<{s.kind.upper()}>" + t[s.end :]
        return t

    left = [(i, masked(i, t), s) for i, t, s in left]
    _, _, taken = brute_mix(left, f"pipeline-{corpus_pipeline.SEED}")
    want = Counter()
    for i, t, s in left:
        want[(i, s, t)] = round(taken[i] / len(words(t)))
    decoded = spm.decode(out.withColumn("id", F.struct("doc_id", "source")), id_col="id", ids_col="ids")
    got = Counter((d.id.doc_id, d.id.source, d.text) for d in decoded.collect())
    assert got == +want
    assert all(n == len(ids) for n, ids in out.select("n_pieces", "ids").collect())


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_take_odd_rows(spark, docs, prose, odd, k):
    """Missing and empty texts, repeated rows, missing ids, a very long text, further columns of clashing names, and no rows at all."""
    rows = [*odd, (70, prose(80, 1), "en", "a"), (70, prose(80, 1), "en", "a"), (71, "very long text with words " * 20_000 + prose(300, 8), "en", None), (None, prose(70, 2), "en", "b")]
    names = ("id", "score", "kept", "class", "n", "q", "u", "own", "size", "key", "ids_", "place", "__gone_", "spans", "base")
    df = docs(rows).withColumns({n: F.lit("clash") for n in names})
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, df, None)
    got = out.collect()
    ids = {r[0] for r in rows}
    assert {r.doc_id for r in got} <= ids
    if name != "pieces":
        assert out.columns == df.columns and all(r.score == "clash" for r in got)
    if name == "near duplicates":
        assert Counter(r.doc_id for r in got)[70] == 1 and Counter(r.doc_id for r in got)[None] == 2
    if name == "personal data":
        assert len(got) == len(rows)
    none = stage(spark, df.limit(0), None)
    assert none.count() == 0 and none.columns == out.columns


def test_places_of_tokens_in_very_large_blocks():
    """A byte more than two holds them, or four where a block has more than 2^24 distinct words."""
    for top, kind in ((0, np.uint8), ((1 << 24) - 1, np.uint8), (1 << 24, np.uint32), ((1 << 30) + 5, np.uint32)):
        at = np.array([0, 70_000, top] if top > 70_000 else [0, top])
        high = lmscore._high(at)
        assert high.dtype == kind
        row = {"words": b"", "sizes": b"", "low": at.astype(np.uint16).tobytes(), "high": high.tobytes()}
        own = np.uint8 if 2 * len(row["high"]) == len(row["low"]) else np.uint32
        assert ((np.frombuffer(row["low"], np.uint16).astype(np.int32) | np.frombuffer(row["high"], own).astype(np.int32) << 16) == at).all()
