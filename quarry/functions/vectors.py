"""Vectors as column expressions (arrays of floats, computed in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def normalize(a: Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def byte_embedding(text: Column, dim: int = 384) -> Column:
    """The offline embedder: the first ``dim`` bytes as ``b / 255 - 0.5``, zeros behind, at unit length."""
    raw = F.hex(F.substring(F.encode(text, "utf-8"), 1, dim))
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    value = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5
    return normalize(F.transform(at, lambda i: F.when(i < F.length(raw) / 2, value(i)).otherwise(F.lit(0.0))))
