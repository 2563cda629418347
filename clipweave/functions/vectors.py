"""Vector arithmetic as columns: arrays of doubles, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    """A vector at length 1; null where it has none."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def similarity01(cos: Column) -> Column:
    """Event similarity (cos + 1) / 2; a missing vector counts as 0."""
    return F.coalesce((cos + 1) / 2, F.lit(0.0))


def calibrated(cos: Column, tau: float) -> Column:
    """clip((cos - tau) / (1 - tau), 0, 1); a missing vector counts as 0."""
    return F.when(cos.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos - tau) / (1 - tau)))).otherwise(0.0)


def fused(name: Column, attributes: Column, *, name_weight: float = 0.4, max_of: bool = False) -> Column:
    """Two similarity channels as one: weighted, or the larger."""
    return F.greatest(name, attributes) if max_of else name_weight * name + (1 - name_weight) * attributes
