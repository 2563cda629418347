"""Interval predicates and measures as columns; an interval is a pair of columns (start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarity of two Allen relations, symmetric, 1 on the diagonal, 0 where not listed.
AFFINITY = {
    ("E", "S"): 0.7, ("E", "Si"): 0.7, ("E", "F"): 0.7, ("E", "Fi"): 0.7,
    ("M", "B"): 0.8, ("Mi", "Bi"): 0.8,
    ("S", "D"): 0.75, ("Si", "Di"): 0.75, ("F", "D"): 0.75, ("Fi", "Di"): 0.75,
    ("O", "D"): 0.6, ("Oi", "Di"): 0.6,
}


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Distance of two intervals, 0 where they touch or overlap."""
    return F.greatest(F.lit(0.0), s1 - e2, s2 - e1)


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column, delta: float = 1e-6) -> Column:
    """Relaxed temporal IoU: (intersection + delta) / (hull + delta); the hull spans both, gaps included."""
    return (intersection(s1, e1, s2, e2) + delta) / (F.greatest(e1, e2) - F.least(s1, s2) + delta)


def allen(s1: Column, e1: Column, s2: Column, e2: Column, eps: float = 1e-3) -> Column:
    """Name of the Allen relation of two intervals with tolerance ``eps``; what no test catches is O or Oi by the midpoints."""
    eq = lambda x, y: F.abs(x - y) <= eps
    lt = lambda x, y: x < y - eps
    tests = [
        ("E", eq(s1, s2) & eq(e1, e2)), ("S", eq(s1, s2) & lt(e1, e2)), ("Si", eq(s1, s2) & lt(e2, e1)),
        ("F", eq(e1, e2) & lt(s2, s1)), ("Fi", eq(e1, e2) & lt(s1, s2)), ("D", lt(s2, s1) & lt(e1, e2)), ("Di", lt(s1, s2) & lt(e2, e1)),
        ("M", eq(e1, s2)), ("Mi", eq(e2, s1)), ("B", lt(e1, s2)), ("Bi", lt(e2, s1)),
        ("O", lt(s1, s2) & lt(s2, e1) & lt(e1, e2)), ("Oi", lt(s2, s1) & lt(s1, e2) & lt(e2, e1)),
    ]
    out = F.when(tests[0][1], tests[0][0])
    for name, test in tests[1:]:
        out = out.when(test, name)
    return out.otherwise(F.when(s1 + e1 <= s2 + e2, "O").otherwise("Oi"))


def affinity(a: Column, b: Column) -> Column:
    """Similarity of two relation names."""
    out = F.when(a == b, 1.0)
    for (x, y), v in AFFINITY.items():
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), v)
    return out.otherwise(0.0)


def delta(reference: Column, generated: Column, *, relative: float, seconds: float) -> Column:
    """Tolerance of the relaxed IoU: the largest of ``relative`` and ``seconds`` by either duration; durations of 0 and null ones give none."""
    part = lambda d: F.when(d != 0, seconds / d)
    return F.greatest(F.lit(relative), part(reference), part(generated))


def sanitized(s: Column, e: Column, total: Column) -> tuple[Column, Column]:
    """An event's ends in order, as shares of ``total``, held to 0 and 1."""
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / total))
    return held(F.least(s, e)), held(F.greatest(s, e))


def custom_affinity(a: Column, b: Column, pairs: dict[tuple[str, str], float]) -> Column:
    """Similarity of two relation names by ``pairs``, symmetric, the larger of two entries for one pair; 1 for equal names, else 0."""
    both: dict[tuple[str, str], float] = {}
    for (x, y), v in pairs.items():
        both[min(x, y), max(x, y)] = max(v, both.get((min(x, y), max(x, y)), 0.0))
    out = F.when(a == b, 1.0)
    for (x, y), v in both.items():
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), v)
    return out.otherwise(0.0)
