"""Vector expressions over array columns, accumulated in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def quality(v: Column, tolerance: float = 1e-5) -> Column:
    """What is wrong with a vector: missing, non_finite, zero, not_unit or ok."""
    x = doubles(v)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        F.when(v.isNull() | (F.size(v) == 0), "missing").when(bad, "non_finite").when(norm(v) == 0, "zero")
        .when(F.abs(norm(v) - 1) > tolerance, "not_unit").otherwise("ok")
    )
