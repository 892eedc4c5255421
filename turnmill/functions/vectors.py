"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, floor: float = 0.0) -> Column:
    """v over its length; a zero vector stays as it is. With a floor, lengths under it count as the floor."""
    n = norm(v)
    by = F.greatest(n, F.lit(floor)) if floor else F.when(n > 0, n).otherwise(1.0)
    return F.transform(v, lambda x: x.cast("double") / by)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def set_cosine(a: Column, b: Column) -> Column:
    """Binary cosine of two arrays of distinct words; 0 where either is empty."""
    n = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)
