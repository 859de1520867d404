"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Components become integers x = floor(256 * c). The scatter matrix M = n * sum(x x') - S S' of the n
distinct vectors is gathered exactly: tasks multiply blocks of rows and send the products' digits of
base 2^30, Spark sums digits by cell. V = M / n^2, so V's eigenvalues are M's over n^2.

1. M's characteristic polynomial modulo many 31-bit primes by Hessenberg reduction, the primes dealt
   over tasks; the integer coefficients by Chinese remaindering. The number of primes follows from a
   bound of the coefficients (M is positive semidefinite with a known trace, so Maclaurin's holds).
2. All roots are real, so the sign changes of the polynomial shifted by a are exactly the number of
   roots over a: bisection on integers isolates the largest roots, which are then narrowed to 2^-96
   of the trace by the polynomial's sign.
3. The eigenvectors of a root are null-space vectors of M minus the root, by inverse iteration in
   fixed-point integers of over 200 bits; a root of multiplicity m gets m orthonormal ones.

What reaches the driver depends on the number of dimensions only, never on rows.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as filled with zeros up to the longest; components beyond 64-bit integers saturate;
equal vectors are one of the fit list and a row each of the result, as are repeated rows; eigenvalues
of zero have no component, so equal vectors only, or none, give no rows; a null vec_id stays null;
``deviation`` is null where it exceeds a long, ``deviation_text`` has its digits always; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
#: Components of the result; bits of a digit of gathered products; most rows multiplied at a time.
COMPONENTS, DIGIT, ROWS = 4, 30, 4096
#: Of a root: bits below the trace. Of a vector's fixed-point numbers: bits after the point, and more than the root has.
ROOT_BITS, VECTOR_BITS = 96, 256
#: Primes a task takes at a time.
PRIMES = 16
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_text string")


def integers(vectors: pa.Array, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) of list values without nulls, a row for each, shorter ones filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    whole = np.where(np.abs(scaled) < 2.0 ** 63, scaled, 0).astype(np.int64)
    whole[scaled >= 2.0 ** 63], whole[scaled < -2.0 ** 63] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = whole
    return out


def product(x: np.ndarray) -> np.ndarray:
    """x' x, exact: in floating point while every sum is below 2^53, else in Python's integers."""
    most = max(-int(x.min()), int(x.max()), 1) if x.size else 1
    if most * most * len(x) < 1 << 53:
        return (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64).astype(object)
    return x.T.astype(object) @ x.astype(object)


def digits(value: int, count: int) -> list[int]:
    """Signed digits of base 2^DIGIT, the last one open to above."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    return [sign * ((value >> (DIGIT * k)) & ((1 << DIGIT) - 1) if k < count - 1 else value >> (DIGIT * k)) for k in range(count)]


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and sum(x x') of the vectors ``x`` (array<long>), as Python's integers."""
    places = [(i, j) for i in range(dims + 1) for j in range(i, dims + 1)]  # a constant 1 before x: its products are n and S

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((dims + 1, dims + 1), object)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.column(0).slice(at, ROWS)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)
                total = total + product(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        cells = np.array([digits(int(total[p]), 6) for p in places], dtype=np.int64)
        i, j = np.array(places, np.int32).T
        for at in range(0, len(places), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[at:at + 100_000]) for v in (i, j, *cells.T)], ["i", "j", *(f"d{k}" for k in range(6))])

    schema = "i int, j int, " + ", ".join(f"d{k} long" for k in range(6))
    cells = fit.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(6))).collect()
    m = np.zeros((dims + 1, dims + 1), object)
    for r in cells:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = sum(r[f"d{k}"] << (DIGIT * k) for k in range(6))
    return int(m[0, 0]), [int(v) for v in m[0, 1:]], m[1:, 1:]


def polynomial_modulo(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(t - m) modulo the prime p (below 2^31)."""
    d = len(m)
    h = m.copy()
    for k in range(1, d - 1):  # Hessenberg form by similarity
        rest = np.flatnonzero(h[k:, k - 1])
        if not len(rest):
            continue
        at = k + int(rest[0])
        if at != k:
            h[[k, at]] = h[[at, k]]
            h[:, [k, at]] = h[:, [at, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for k in range(d):  # t - h of the leading k + 1 rows
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - int(h[k, k]) * polys[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            c = below * int(h[i, k]) % p
            if c:
                new[:i + 1] = (new[:i + 1] - c * polys[i]) % p
        polys.append(new)
    return polys[d] % p


def is_prime(n: int) -> bool:
    """For odd n below 2^32."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 7, 61):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31 whose product exceeds ``bound``."""
    out, of, n = [], 1, (1 << 31) - 1
    while of <= bound:
        if is_prime(n):
            out.append(n)
            of *= n
        n -= 2
    return out


def coefficient_bound(trace: int, dims: int) -> int:
    """A bound of all coefficients: the k-th is at most binomial(dims, k) (trace / dims)^k, as no eigenvalue is negative."""
    mean = trace // dims + 1
    return max(math.comb(dims, k) * mean ** k for k in range(dims + 1))


def characteristic_polynomial(spark, m: np.ndarray) -> list[int]:
    """Integer coefficients, constant first, of det(t - m) of a positive semidefinite integer matrix."""
    d = len(m)
    primes = primes_for(2 * coefficient_bound(sum(int(m[k, k]) for k in range(d)), d))
    shared = spark.sparkContext.broadcast(m)  # dims x dims numbers

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = [polynomial_modulo((shared.value % p).astype(np.int64), p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], ["p", "residues"])

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES))
    rows = table.mapInArrow(run, "p long, residues array<long>").collect()  # as many rows as primes
    whole = math.prod(primes)
    total = [0] * (d + 1)
    for r in rows:
        rest = whole // r["p"]
        basis = rest * pow(rest, -1, r["p"])
        total = [t + int(c) * basis for t, c in zip(total, r["residues"], strict=True)]
    return [t % whole if t % whole <= whole // 2 else t % whole - whole for t in total]


def roots_over(poly: list[int], a: int) -> int:
    """Number of roots over a (all roots are real): the sign changes of poly(t + a)."""
    c = list(poly)
    for k in range(len(c) - 1):
        for j in range(len(c) - 2, k - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs[1:], signs[:-1], strict=True))


def value_at(poly: list[int], a: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * a + c
    return value


def largest_roots(poly: list[int], trace: int, count: int) -> tuple[list[tuple[int, int]], int]:
    """The largest positive roots, at least ``count`` if there are as many, as (root times 2^shift, multiplicity), falling,
    and shift. Each is the upper end of an interval of 2^-shift."""
    shift = max(0, ROOT_BITS - trace.bit_length())
    d = len(poly) - 1
    q = [c << (shift * (d - k)) for k, c in enumerate(poly)]  # roots times 2^shift
    found: list[tuple[int, int]] = []
    todo = [(0, trace << shift, roots_over(q, 0), 0)]  # (low, high], roots over low, roots over high
    while todo and sum(n for _, n in found) < count:
        low, high, above_low, above_high = todo.pop()
        n = above_low - above_high
        if not n:
            continue
        if high - low == 1:
            found.append((high, n))
        elif n == 1:  # the sign changes once within
            end = value_at(q, high)
            while end and high - low > 1:
                mid = (low + high) // 2
                if (value_at(q, mid) > 0) == (end > 0):
                    high = mid
                else:
                    low = mid
            found.append((high, 1))
        else:
            mid = (low + high) // 2
            above_mid = roots_over(q, mid)
            todo += [(low, mid, above_low, above_mid), (mid, high, above_mid, above_high)]
    return found, shift


def null_vectors(m: np.ndarray, root: int, shift: int, count: int) -> np.ndarray:
    """``count`` orthonormal vectors, as rows, of the null space of m - root / 2^shift, by inverse iteration in fixed-point
    numbers of VECTOR_BITS + shift bits after the point."""
    d, point = len(m), VECTOR_BITS + shift
    one = 1 << point
    a = m * one
    a[np.arange(d), np.arange(d)] -= root << (point - shift)
    order = list(range(d))
    for k in range(d):  # factors of a, with row exchanges; a pivot of zero becomes the smallest number
        at = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        a[[k, at]] = a[[at, k]]
        order[k], order[at] = order[at], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            f = np.array([(int(v) << point) // int(a[k, k]) for v in a[k + 1:, k]], object)
            a[k + 1:, k] = f
            a[k + 1:, k + 1:] -= (f[:, None] * a[k, k + 1:]) >> point
    rng = np.random.default_rng(count)
    out: list[np.ndarray] = []
    for _ in range(count):
        v = np.array([int(x) for x in rng.integers(1, 1 << 20, d)], object) * (one >> 20)
        for _ in range(3):
            y = v[order].copy()
            for k in range(d):
                y[k + 1:] -= (a[k + 1:, k] * y[k]) >> point
            for k in range(d - 1, -1, -1):
                y[k] = (int(y[k]) << point) // int(a[k, k])
                y[:k] -= (a[:k, k] * y[k]) >> point
            y = _unit(y, point)
            for w in out * 2:
                y = _unit(y - ((w * (int((w * y).sum()) >> point)) >> point), point)
            v = y
        out.append(v)
    return np.array([[float(int(x) / one) for x in v] for v in out])


def _unit(v: np.ndarray, point: int) -> np.ndarray:
    norm = math.isqrt(int((v * v).sum()))
    return np.array([(int(x) << point) // norm for x in v], object)


def components(spark, m: np.ndarray, count: int = COMPONENTS) -> tuple[list[float], np.ndarray]:
    """The largest eigenvalues of m (falling, positive ones only) as shares of its trace, and unit eigenvectors as rows."""
    trace = sum(int(m[k, k]) for k in range(len(m)))
    if not trace:
        return [], np.zeros((0, len(m)))
    roots, shift = largest_roots(characteristic_polynomial(spark, m), trace, count)
    values, vectors = [], []
    for root, n in roots:
        vectors.append(null_vectors(m, root, shift, n))
        values += [root / (trace << shift)] * n
    return values[:count], np.concatenate(vectors)[:count]


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & ~bad)


def whiten(rows: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text for the rows (vec_id, embedding)
    that take part, and each component up to COMPONENTS."""
    spark = rows.sparkSession
    rows = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], RESULT)

    def quantised(batches):
        for b in batches:
            x = integers(b.column(1), dims)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), x.reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["vec_id", "x"])

    x = rows.mapInArrow(quantised, "vec_id long, x array<long>")
    fit = stored(x.select("x").distinct(), "whitening-fit")
    n, sums, squares = scatter(fit, dims)
    m = n * squares - np.outer(np.array(sums, object), np.array(sums, object))
    shares, vectors = components(spark, m)
    if not shares:
        return spark.createDataFrame([], RESULT)
    trace = sum(int(m[k, k]) for k in range(dims))
    scale = [math.sqrt(share * (trace / (n * n))) for share in shares]
    matrix = vectors.T / np.array(scale)
    small = max(map(abs, sums), default=0) < 1 << 40 and n < 1 << 22

    def white(x: np.ndarray) -> np.ndarray:
        """Coordinates, from n x - S: centred exactly while that fits a double, then multiplied."""
        top = max(-int(x.min()), int(x.max())) if x.size else 0
        if (top + 1) * n + max(map(abs, sums)) < 1 << 62:
            centred = (x * n - np.array(sums, np.int64)).astype(np.float64) / n
        else:
            centred = ((x.astype(object) * n - np.array(sums, object)) / n).astype(np.float64)
        return centred @ matrix

    def deviations(x: np.ndarray) -> list[int]:
        top = max(-int(x.min()), int(x.max())) if x.size else 0
        if small and (((top + 1) * n + max(map(abs, sums))) ** 2) * dims < 1 << 63:
            return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        return [int(v) for v in ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)]

    names = [f"w{k}" for k in range(len(shares))]

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.column(0).slice(at, ROWS)
                w = white(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], names)

    seen = fit.mapInArrow(project, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    cov = seen.agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))

    def result(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                ids, vectors = b.column(0).slice(at, ROWS), b.column(1).slice(at, ROWS)
                x = integers(vectors, dims)
                k = len(shares)
                w, dev, each = white(x), deviations(x), np.repeat(np.arange(len(x)), k)
                repeated = [dev[r] for r in each]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n, np.int64)),
                    pa.array([d if d < 1 << 63 else None for d in repeated], pa.int64()), pa.array(w.reshape(-1)), pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(each), error)), pa.array([str(d) for d in repeated], pa.string())], [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(result, RESULT)
