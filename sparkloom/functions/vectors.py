"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for vectors of unequal length or without one."""
    product = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (product == 0) | product.isNull(), F.lit(0.0)).otherwise(dot(a, b) / product)


def single(vector: Column) -> Column:
    """A vector as it is stored: single precision."""
    return vector.cast("array<float>")
