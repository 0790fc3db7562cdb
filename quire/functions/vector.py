"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null elements count as zero (SCA34)."""
    parts = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal lengths or a zero vector (SCA33)."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.try_divide(dot(a, b), size)).otherwise(0.0)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def model_of(dimensions: Column) -> Column:
    """Family of embedding model by vector length (SRC16)."""
    return F.when(dimensions == 1536, "text-1536").when(dimensions == 768, "text-768").otherwise("unknown")
