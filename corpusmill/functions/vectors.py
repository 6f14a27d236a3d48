"""Vector expressions on ARRAY columns (VEC-1..3), evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def sq_norm(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_normalize(v) -> Column:
    """x / max(||x||, 1e-12) element-wise."""
    d = as_double(v)
    n = F.greatest(F.sqrt(sq_norm(d)), F.lit(EPS))
    return F.transform(d, lambda x: x / n)


def dot(u, v) -> Column:
    return F.aggregate(F.zip_with(as_double(u), as_double(v), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def sq_distance(u, v) -> Column:
    return F.aggregate(F.zip_with(as_double(u), as_double(v), lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(u, v) -> Column:
    return dot(l2_normalize(u), l2_normalize(v))


def argmax(v) -> Column:
    """0-based index of the largest element (first on ties)."""
    return F.array_position(_c(v), F.array_max(_c(v))) - 1
