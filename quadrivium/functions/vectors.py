"""Vector functions over array columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(a: Column | str) -> Column:
    """Not null, not empty, without null or NaN elements and not all zero."""
    v = col(a)
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (norm(v) > 0), F.lit(False))


def unit(values: list[float]) -> Column:
    size = sum(float(v) ** 2 for v in values) ** 0.5
    if not size:
        raise ValueError("a query vector must not be zero")
    return F.array(*[F.lit(float(v) / size) for v in values])


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
