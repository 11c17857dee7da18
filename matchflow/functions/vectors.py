"""Vector columns: dot product, norm, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, for pairs that are already joined."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors; 0 with a zero vector, whose dot product is 0 already."""
    return dot(a, b)
