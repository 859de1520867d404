import math

import numpy as np
import pytest

from ragtab.llm import whitening as X

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "clash", 1, "c") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows):
    """Rows that take part, n, deviations, whitened (up to sign) and shares, by a dense eigenvalue solver."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in good)
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v)) for _, v in good], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    dev = [int(d) for d in ((n * x - s).astype(object) ** 2).sum(axis=1)]
    return [i for i, _ in good], n, dev, (x - s / n) @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(spark, rows, tolerance=1e-9):
    got = X.whiten(frame(spark, rows)).collect()
    ids, n, dev, white, shares = brute(rows)
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["deviation_text"]) for r in got) == sorted(
        (i, k, n, d, str(d)) for i, d in zip(ids, dev, strict=True) for k in range(1, 5))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    for k in range(4):
        mine = {}
        for r in got:
            if r["component"] == k + 1:
                mine[r["vec_id"]] = r["whitened"]
                assert abs(r["explained"] - shares[k]) < 1e-10 * shares[k] + 1e-15
        a, b = np.array([mine[i] for i in ids]), white[:, k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance


def vectors(n, d, seed=0, scale=0.3):
    return np.random.default_rng(seed).normal(0, scale, (n, d)).astype(np.float32).tolist()


def test_brute_force_on_odd_rows(spark):
    rows = list(enumerate(vectors(120, 9)))
    rows += [(200, None), (201, [None] * 9), (202, [1.0] * 8 + [float("nan")]), (203, [float("inf")] + [0.0] * 8), (204, rows[3][1]), rows[5],
             (205, [0.5, -0.25]), (206, [])]
    rows = [r for r in rows if r[0] != 5] + [(5, rows[5][1])]
    check(spark, rows)


def test_whole_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    check(spark, list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)))


def test_large_components_stay_exact(spark):
    rows = list(enumerate((np.array(vectors(40, 5, 3)) * 1e9).tolist()))
    got = X.whiten(frame(spark, rows)).collect()
    ids, n, dev, white, _ = brute(rows)
    assert {(r["vec_id"], r["deviation_text"]) for r in got} == {(i, str(d)) for i, d in zip(ids, dev, strict=True)}
    assert all(r["deviation"] is None for r in got) and got[0]["identity_error"] < 1e-10


def test_repeated_eigenvalues_and_rank(spark):
    """A cube's corners: three equal eigenvalues, a fourth of zero."""
    rows = [(4 * a + 2 * b + c, [a * 1.0, b * 1.0, c * 1.0, 2.0]) for a in (0, 1) for b in (0, 1) for c in (0, 1)] * 3
    got = X.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and {r["n"] for r in got} == {8}
    assert got[0]["identity_error"] < 1e-12 and all(abs(r["explained"] - 1 / 3) < 1e-15 for r in got)
    assert len(got) == 72


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_whiten(spark, rows):
    got = X.whiten(frame(spark, rows))
    assert got.columns == [c.split()[0] for c in X.RESULT.split(", ")] and got.count() == 0


def test_polynomial_roots_and_vectors(spark):
    """Against factors that are known: integer roots with multiplicities, turned by a unimodular similarity."""
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 7):
        a = rng.integers(-5, 6, (d, d)).astype(object)
        m = a.T @ a
        poly = X.characteristic_polynomial(spark, m)
        assert poly[d] == 1 and poly[d - 1] == -sum(m[k, k] for k in range(d))
        for t in (-3, 0, 2, 11):  # det(t - m) by fractions
            from fractions import Fraction

            f = [[Fraction(int((i == j) * t - m[i, j])) for j in range(d)] for i in range(d)]
            det = Fraction(1)
            for k in range(d):
                at = next((r for r in range(k, d) if f[r][k]), None)
                if at is None:
                    det = Fraction(0)
                    break
                if at != k:
                    f[k], f[at], det = f[at], f[k], -det
                det *= f[k][k]
                for r in range(k + 1, d):
                    g = f[r][k] / f[k][k]
                    f[r] = [x - g * y for x, y in zip(f[r], f[k], strict=True)]
            assert sum(c * t ** k for k, c in enumerate(poly)) == det
    poly = [1]
    for root in (0, 3, 3, 5, 1000):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    assert [X.roots_over(poly, a) for a in (-1, 0, 2, 3, 4, 5, 999, 1000)] == [5, 4, 4, 2, 2, 1, 1, 0]
    roots, shift = X.largest_roots(poly, 1011, 4)
    assert [(r / 2 ** shift, n) for r, n in roots] == [(1000, 1), (5, 1), (3, 2)]


def test_close_eigenvalues(spark):
    """Eigenvalues that agree in 12 digits still give orthonormal eigenvectors."""
    m = np.array([[10 ** 12, 1, 0], [1, 10 ** 12, 0], [0, 0, 5]], object)
    shares, v = X.components(spark, m, 3)
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-15
    assert np.allclose(np.abs(v[:2, :2]), math.sqrt(0.5), atol=1e-15)
    assert shares[0] > shares[1] > shares[2]
