"""Property tests of the block kernels (run in-process, no Spark) and of the
partial/final top-k split under arbitrary partitionings."""

from collections import Counter
import math

import numpy as np
from hypothesis import given, settings, strategies as st

from ragtab.operators import topk

WORDS = ["a", "b", "c", "d", "e", "ß", "é"]
texts = st.lists(st.sampled_from(WORDS), min_size=0, max_size=8)


def _brute(qs, ds, k):
    out = []
    for qi, qt in enumerate(qs):
        cq = Counter(qt)
        cand = []
        for di, dt in enumerate(ds):
            cd = Counter(dt)
            dot = sum(cq[t] * cd[t] for t in cq)
            if dot <= 0:
                continue
            s = dot / (math.sqrt(sum(v * v for v in cq.values())) * math.sqrt(sum(v * v for v in cd.values())))
            cand.append((math.floor(s * 1e6 + 0.5) / 1e6, 100 + di))
        cand.sort(key=lambda x: (-x[0], x[1]))
        out += [(qi, d, s) for s, d in cand[:k]]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.lists(texts, min_size=1, max_size=12),
       st.integers(1, 4), st.integers(1, 5), st.integers(1, 40))
def test_lexical_kernel_any_split(qs, ds, k, n_splits, cells):
    old = topk._CELLS
    topk._CELLS = cells                      # tiny slices exercise the chunk loops
    try:
        kern = topk.LexicalKernel().prepare(np.arange(len(qs)), [np.array(t, dtype=object) for t in qs])
        acc = topk._TopK(k)
        ids = np.arange(100, 100 + len(ds))
        for part in np.array_split(np.arange(len(ds)), n_splits):   # any partitioning of the corpus
            kern.score_into(acc, ids[part], [np.array(ds[i], dtype=object) for i in part])
        got = sorted(zip(acc.q.tolist(), acc.d.tolist(), acc.s.tolist()))
    finally:
        topk._CELLS = old
    assert got == _brute(qs, ds, k)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 5), st.integers(1, 6), st.integers(0, 10_000))
def test_dense_kernel_matches_numpy(nq, nd, k, n_splits, seed):
    rng = np.random.default_rng(seed)
    Q = rng.integers(-3, 4, size=(nq, 3)).astype(float)
    D = rng.integers(-3, 4, size=(nd, 3)).astype(float)
    kern = topk.DenseKernel("cosine").prepare(np.arange(nq), list(Q))
    acc = topk._TopK(k)
    ids = np.arange(nd) + 1000
    for part in np.array_split(np.arange(nd), n_splits):
        kern.score_into(acc, ids[part], [D[i] for i in part])
    exp = []
    for i in range(nq):
        cand = []
        for j in range(nd):
            den = np.linalg.norm(Q[i]) * np.linalg.norm(D[j])
            if den > 0:
                cand.append((float(topk.round6(np.array(Q[i] @ D[j] / den))), 1000 + j))
        cand.sort(key=lambda x: (-x[0], x[1]))
        exp += [(i, d) for _, d in cand[:k]]
    assert sorted(zip(acc.q.tolist(), acc.d.tolist())) == sorted(exp)
