"""The event total as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of matched quality, relations and coverage.
WEIGHTS = (0.2, 0.2, 0.6)


def event_total(ega: Column, erel: Column, ecr: Column, *, weights: tuple[float, float, float] = WEIGHTS, without: tuple[float, float] | str = (0.2, 0.8)) -> Column:
    """Weighted total; ``without`` a relation score the other two weigh as told: by two numbers, ``equal``, or ``proportional`` to their weights.

    A missing quality counts 0.
    """
    a, b, c = weights
    if without == "equal":
        x, y = 0.5, 0.5
    elif without == "proportional":
        x, y = a / (a + c), c / (a + c)
    else:
        x, y = without
    e = F.coalesce(ega, F.lit(0.0))
    return F.when(erel.isNotNull(), a * e + b * erel + c * ecr).otherwise(x * e + y * ecr)
