"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector is zero or null."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(v: Column) -> Column:
    """``v`` scaled to length 1; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_doubles(v), lambda x: x / n)).otherwise(as_doubles(v))
