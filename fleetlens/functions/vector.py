"""Vectors held as arrays; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """SF21"""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalise(a) -> Column:
    """SF21: scaled to length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))

