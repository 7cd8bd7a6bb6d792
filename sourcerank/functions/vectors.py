"""Row-wise vector columns over array<float|double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def _with(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column, eps: float = 0.0) -> Column:
    """v / (|v| + eps); with eps 0 a zero vector stays zero."""
    length = F.nullif(norm(v) + F.lit(eps), F.lit(0.0))
    return _with(length, lambda n: F.transform(v, lambda x: F.coalesce(x.cast("double") / n, F.lit(0.0))))


def l2_similarity(sq_a: Column, sq_b: Column, dot_ab: Column) -> Column:
    """Negative distance from squared norms and the dot product."""
    return -F.sqrt(F.greatest(sq_a + sq_b - 2 * dot_ab, F.lit(0.0)) + F.lit(1e-9))
