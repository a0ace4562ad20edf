"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine within [0, 1]; 0 for empty vectors, zero norms and unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    sound = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(sound, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norms)))).otherwise(F.lit(0.0))


def distance_score(d: Column) -> Column:
    """1 / (1 + distance) within [0, 1]; null without a distance."""
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.lit(1.0), 1.0 + d))))


def mean(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors; empty for none."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(n - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n)).otherwise(F.array().cast("array<double>"))
