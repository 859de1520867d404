import random

import llm_cases as C
import numpy as np
import pytest

from ragtab.llm import ngram_join as X


def brute(rows):
    sets = []
    for i, t, *_ in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append((i, {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()))
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low.setdefault(root(k), []).append(i)
    return sorted(((i, len(s), min((x for x in low[root(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)), key=repr)


def joined(df, **how):
    return sorted((tuple(r) for r in X.similarity_join(df, **how).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_brute_force_on_odd_rows(spark, clash):
    rows = C.odd_rows()
    assert joined(C.frame(spark, rows, clash)) == brute(rows)


def test_links_through_documents_without_an_id(spark):
    """A and C are linked through B only; B has no id, and neither has any of D and E. A text of over a megabyte."""
    words = [f"w{k}" for k in range(100)]
    a, b, c = words, words[:96] + ["x1"], words[:90] + ["x1", "x2"]
    assert [len(z) for z in (a, b, c)]
    rows = [(1, " ".join(a), "", "", 0), (None, " ".join(b), "", "", 0), (3, " ".join(c[:86] + ["x3"]), "", "", 0), (None, "p q r s t u v", "", "", 0), (None, "P q r s t u v", "", "", 0),
            (9, "long " * 300_000, "", "", 0), (8, " ".join(f"v{k}" for k in range(200_000)), "", "", 0), (7, " ".join(f"v{k}" for k in range(199_000)), "", "", 0)]
    want = brute(rows)
    assert joined(C.frame(spark, rows)) == want
    assert {r[2] for r in want if r[0] in (1, 3)} == {1} and {r[2] for r in want if r[0] in (7, 8)} == {7}
    kept = X.near_dedup_stage(C.frame(spark, rows, clash=True)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == [1, 7, 9, None]


@pytest.mark.parametrize("small, tried", [(2, 0), (2, 1), (16, 8)])
def test_dense_group_and_leftovers_just_short(spark, monkeypatch, small, tried):
    """A large group of near copies, texts just short of the similarity to most of it, two groups that one text joins; small blocks."""
    monkeypatch.setattr(X, "SIDE_BYTES", 4000)
    monkeypatch.setattr(X, "SMALL_KEY", small)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for size, times in ((1, 60), (2, 40), (4, 25), (5, 25), (6, 25), (9, 20)):
        for _ in range(times):
            w = list(base)
            for _ in range(size):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(w), "", "", 0))
    other = [f"o{k}" for k in range(150)]
    rows += [(1000 + k, " ".join(other[:140 + k % 3] + [f"y{k}"]), "", "", 0) for k in range(30)]
    assert joined(C.frame(spark, rows), tried=tried) == brute(rows)


def test_ids_that_repeat(spark):
    """Two texts under one id: each is decided on by itself; one document of each component stays."""
    long = "one two three four five six seven"
    rows = [(1, "alpha", "", "", 1), (1, "gamma", "", "", 1), (0, "gamma", "", "", 1), (2, long, "", "", 1), (2, long.upper(), "", "", 1), (3, "", "", "", 0), (3, None, "", "", 0)]
    kept = sorted((r["doc_id"], r["text"]) for r in X.near_dedup_stage(C.frame(spark, rows)).na.fill("null").collect())
    assert kept in ([(0, "gamma"), (1, "alpha"), (2, t), (3, ""), (3, "null")] for t in (long, long.upper()))


@pytest.mark.parametrize("frequent", [2, 5, 10**9])
def test_brute_force_with_frequent_shingles(spark, frequent, monkeypatch):
    """Few words and many near copies: most shingles are frequent, sizes vary."""
    rng = random.Random(frequent)
    rows = []
    for g in range(10):
        base = [f"g{g}w{k}" for k in range(rng.randrange(5, 120))]
        for _ in range(12):
            w = base[:rng.randrange(max(1, len(base) * 3 // 4), len(base) + 1)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows) + 1, " ".join(w), "", "", 0))
    monkeypatch.setattr(X.frequent_shingles, "__defaults__", (frequent, 1 << 18, (6, 9)))
    got = joined(C.frame(spark, rows))
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(4, 200))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = x[rng.random(len(x)) > 0.08]
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 12))).astype(np.uint64)]))
        frequent = np.unique(np.concatenate([x, y])[rng.random(len(x) + len(y)) > rng.choice([0.0, 0.3, 0.9])])
        if len(y) and X.linked(x, y) and len(x) > 3 and not (len(x) == len(y) and (x == y).all()):
            levels = rng.integers(2, int(rng.choice([3, 4, 5])), len(frequent))
            assert np.intersect1d(X.keys_of(x, frequent, levels), X.keys_of(y, frequent, levels)).size


def test_signatures_never_rule_out_links():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(500):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.choice([0.02, 0.1, 0.5])], rng.integers(0, 1 << 62, n // 20).astype(np.uint64)]))
        if len(y):
            may = X.may_link(len(x), X.signature(x), len(y), X.signature(y))
            assert may or not X.linked(x, y)
            ruled_out += not may
    assert ruled_out > 100


def test_empty_table(spark):
    assert X.similarity_join(C.frame(spark, [])).count() == 0


def test_stage_keeps_one_of_each_component(spark):
    docs = C.frame(spark, C.odd_rows(), clash=True)
    out = X.near_dedup_stage(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {r["component_id"] for r in X.similarity_join(docs).collect()}
    assert out.count() == out.select("doc_id", "text").distinct().count()
