"""Vector column functions over ``ARRAY<DOUBLE>`` (JVM-side higher-order functions).

Spark has no vector type for SQL arrays; these are the per-row forms. Bulk
nearest-neighbour search uses the blocked Arrow kernel in ``operators.topk``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    sq = F.transform(as_double_array(v), lambda x: x * x)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    """dot / (|a| |b|); NULL for a zero or NULL vector instead of NaN, so later
    comparisons such as ``> 0.7`` are false (Spark orders NaN above every number)."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def l2_relevance(a, b) -> Column:
    """Relevance of a squared-L2 store: ``1 - d / sqrt(2)`` with d the squared
    Euclidean distance."""
    diffs = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    d = F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)
    return F.lit(1.0) - d / F.lit(math.sqrt(2.0))


def nan_to_null(x) -> Column:
    return F.nanvl(_c(x), F.lit(None).cast("double"))
