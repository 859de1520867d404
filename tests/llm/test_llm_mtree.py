import math

import llm_cases as C
import numpy as np
import pyarrow as pa
import pytest

from ragtab.llm import mtree as X

SCHEMA = "vec_id long, embedding array<float>, label int, root string, x int, score string, rank int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "clash", 1, "s", 9) for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k=10, of=100):
    good = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in good if i is not None and i % of == 0}:
        scores = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in good if j != i]  # noqa: B905  (shorter ones end early)
        out += [(i, r, None if lost else j, -s) for r, (s, lost, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def same(spark, rows, **how):
    got = X.exact_top_k(frame(spark, rows), **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def vectors(n, d, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, d))
    if clusters:
        x = rng.normal(0, 1, (clusters, d))[rng.integers(0, clusters, n)] + x / 10
    return x.astype(np.float32).tolist()


@pytest.mark.parametrize("clusters", [0, 12])
def test_brute_force(spark, clusters):
    same(spark, [(7 * i, v) for i, v in enumerate(vectors(3000, 12, 1, clusters))])


def test_odd_rows_ties_and_copies(spark):
    v = vectors(300, 6, 2)
    rows = [(50 * i, x) for i, x in enumerate(v)] + [(3 + i, v[2]) for i in range(700)]  # a common vector: many ties
    rows += [(200, v[4]), (200, v[4]), (300, v[9]), (None, v[2]), (None, v[8]), (400, v[2]), (1, None), (2, [None] * 6), (100, [float("nan")] * 6),
             (600, [float("inf")] + [0.0] * 5), (5, [0.5, 0.5]), (700, []), (-100, v[7]), (0, [0.0] * 6)]
    same(spark, rows)


@pytest.mark.parametrize("rows", [[], [(100, None)], [(100, [])], [(100, [0.5])], [(1, [0.5]), (2, [1.0])], [(0, [0.5]), (2, [1.0])]])
def test_few_rows(spark, rows):
    same(spark, rows)


def test_blocks_and_subtrees(spark, monkeypatch):
    """Queries in several blocks, a crowded routing object in several subtrees."""
    monkeypatch.setattr(X, "BLOCK_BYTES", 4000)
    rows = [(10 * i, v) for i, v in enumerate(vectors(900, 5, 3, 2) + [[0.25] * 5] * 300)]
    index = X.Index.of(frame(spark, rows), subtree=64)
    assert index.pages.count() > len(index.roots)
    got = index.top_k(frame(spark, [r for r in rows if r[0] % 100 == 0]), 10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_large_components_are_exact(spark):
    same(spark, [(10 * i, [c * 1e5 for c in v]) for i, v in enumerate(vectors(150, 3, 4))])


def test_bounds_save_computations():
    x = X.integers(pa.array(vectors(8000, 6, 5, 40)), 6)
    bound = float(X.squares(x).max()) + 1.0
    centre = X.augmented(x[:1], bound)[0]
    row = X.build(0, 0, np.arange(len(x)), np.zeros(len(x), bool), x, centre, bound)
    tree = X.Subtree({c: v.tobytes() if isinstance(v, np.ndarray) else v for c, v in row.items()}, 6, bound)
    computed = 0
    for q in range(0, 400, 20):
        best = X.Best(q, x[q], bound, 10, None)
        X.search(tree, best, float(X.distances(np.append(x[q], 0.0)[None], centre[None])[0, 0]))
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:10]
        assert [(-s, i) for s, i in zip(best.scores, best.ids, strict=True)] == want
        computed += best.computed
    assert computed < 0.5 * 20 * len(x)
    radius = [np.sqrt(X.squares(X.augmented(tree.x, bound)[s:e] - X.augmented(tree.x, bound)[a])).max() for s, e, a in
              zip(tree.leaf_start[:-1], tree.leaf_start[1:], tree.leaf_at, strict=True)]
    assert np.allclose(radius, tree.leaf_radius)


def test_oracle(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    C.same_rows(X.exact_top_k(frame(spark, rows)), C.duck(embeddings=t.to_pandas()).execute(X.ORACLE))
