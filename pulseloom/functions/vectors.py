"""Vector arithmetic as column expressions, for single pairs; bulk comparison lives in operators.similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Zero for vectors of unequal length and for a zero vector."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), F.lit(0.0)).otherwise(dot(a, b) / length)



def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    length = norm(v)
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))
