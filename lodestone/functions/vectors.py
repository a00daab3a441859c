"""Vector expressions and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null or zero vector, one with a part that is null or not finite, or for vectors of
    unequal length."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))  # a part that is infinite makes this NaN
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value), value)


def is_finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
