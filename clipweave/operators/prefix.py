"""What lies before a row within its key, for keys of any length: by buckets of the order, then within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_START, _BEFORE = Window.unboundedPreceding, -1


def with_before(rows: DataFrame, key: str, bucket: Column, order: list[str], *, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with sums (0 of nothing) and maxima (null of nothing) over all rows of the same key that come before in ``order``.

    ``bucket`` must not fall along ``order``. A window over a key sees one row for each of its buckets, and one over a bucket its rows, so
    that a long key is spread over tasks.
    """
    sums, maxima = sums or {}, maxima or {}
    own = rows.withColumn("_bucket", bucket)
    parts = [F.sum(c).alias(f"_c_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_c_{n}") for n, c in maxima.items()]
    total = own.groupBy(key, "_bucket").agg(*parts)
    over_key = Window.partitionBy(key).orderBy("_bucket").rowsBetween(_START, _BEFORE)
    carried = total.select(key, "_bucket", *((F.sum if n in sums else F.max)(f"_c_{n}").over(over_key).alias(f"_c_{n}") for n in [*sums, *maxima]))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(_START, _BEFORE)
    both = own.join(carried, [key, "_bucket"])
    out = {n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    out |= {n: F.greatest(F.col(f"_c_{n}"), F.max(c).over(inside)) for n, c in maxima.items()}
    return both.withColumns(out).drop("_bucket", *(f"_c_{n}" for n in out))


def with_number(rows: DataFrame, key: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in ``order`` within the key, from 0."""
    return with_before(rows, key, bucket, order, sums={name: F.lit(1).cast("long")})
