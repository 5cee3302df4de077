"""Vector and matrix expressions over array columns; sums run in index order, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def add(*vs: Column) -> Column:
    out = vs[0]
    for v in vs[1:]:
        out = F.zip_with(out, v, lambda x, y: x + y)
    return out


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * (k if isinstance(k, Column) else F.lit(float(k))))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return norm(d)


def matmul(rows: Column, v: Column) -> Column:
    """Matrix as an array of rows times a vector."""
    return F.transform(rows, lambda r: dot(r, v))
