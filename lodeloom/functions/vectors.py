"""Vector columns (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column, eps: float = 1e-9) -> Column:
    return F.transform(v, lambda x: x / (norm(v) + eps))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def round_signed(x: Column, places: int) -> Column:
    """``round`` that keeps the sign of what becomes 0, as IEEE 754 has it: -0.0 for a small negative number."""
    out = F.round(x, places)
    return F.when(out == 0, x * 0.0).otherwise(out)


def _scaled(v: Column, weight: float) -> Column:
    return F.transform(v, lambda x: x * weight)


def weighted_mean(vectors: list[tuple[Column, float]]) -> Column:
    """Of the vectors that are not null."""
    total = sum((F.when(v.isNotNull(), F.lit(wt)).otherwise(0.0) for v, wt in vectors), F.lit(0.0))
    out = None
    for v, wt in vectors:
        part = _scaled(v, wt)
        out = part if out is None else F.when(part.isNull(), out).when(out.isNull(), part).otherwise(F.zip_with(out, part, lambda x, y: x + y))
    return F.transform(out, lambda x: x / total)
