"""Joins, merges and resampling of intervals and events as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], *, width: float, s: str = "s", e: str = "e") -> DataFrame:
    """Pairs of rows of equal ``keys`` whose intervals overlap; right columns get the suffix ``_r``.

    Intervals are dealt into buckets of ``width``, so the join is an equi-join on (keys, bucket) that shuffles by bucket and not by key
    alone; a pair is reported in the first bucket that both touch. Choose ``width`` near the usual length.
    """
    buckets = lambda a, b: F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))
    renamed = right.select(*(F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns))
    a = left.withColumn("_b", F.explode(buckets(F.col(s), F.col(e))))
    b = renamed.withColumn("_b", F.explode(buckets(F.col(f"{s}_r"), F.col(f"{e}_r"))))
    first = F.greatest(F.floor(F.col(s) / width), F.floor(F.col(f"{s}_r") / width))
    hit = (F.col(s) < F.col(f"{e}_r")) & (F.col(f"{s}_r") < F.col(e)) & (F.col("_b") == first)
    return a.join(b, [*keys, "_b"]).where(hit).drop("_b")


def islands(spans: DataFrame, keys: list[str], *, tolerance: float = 0.0, s: str = "s", e: str = "e") -> DataFrame:
    """Spans of a key that overlap or lie within ``tolerance`` of what came before become one: keys, s, e, n."""
    w = Window.partitionBy(*keys).orderBy(s, e)
    upto = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col(s) <= upto + tolerance, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(s).alias(s), F.max(e).alias(e), F.count("*").alias("n")).drop("_island")


def nearest_fill(rows: DataFrame, keys: list[str], order: str, value: str, known: Column, *, most: float, out: str) -> DataFrame:
    """``value`` of the nearest row that is ``known``, looking both ways as far as ``most`` in ``order``; equally near, the earlier one."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.when(known, F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    back = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumn("_back", back).withColumn("_ahead", ahead)
    db, da = F.col(order) - F.col("_back.t"), F.col("_ahead.t") - F.col(order)
    pick = F.when((db <= most) & (da.isNull() | (db <= da)), F.col("_back.v")).when(da <= most, F.col("_ahead.v"))
    return both.withColumn(out, pick).drop("_back", "_ahead")


def hop_windows(rows: DataFrame, at: str, *, size: float, hop: float) -> DataFrame:
    """A row for each hopping window [start, start + size) that ``at`` lies in; starts are multiples of ``hop``."""
    last = F.floor(F.col(at) / hop)
    first = F.floor((F.col(at) - size) / hop) + 1
    return rows.withColumn("_k", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("win_start", F.col("_k") * hop).drop("_k")


def segments(bounds: DataFrame, keys: list[str], at: str, *, least: float) -> DataFrame:
    """Consecutive boundaries of a key as segments (s, e) no shorter than ``least``."""
    w = Window.partitionBy(*keys).orderBy(at)
    return bounds.withColumn("e", F.lead(at).over(w)).where(F.col("e") - F.col(at) >= least).select(*keys, F.col(at).alias("s"), "e")


def peaks(rows: DataFrame, keys: list[str], order: str, height: str, *, least: float) -> DataFrame:
    """Rows strictly above the one before, not below the one after, and at least ``least`` high."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(height).over(w), F.lead(height).over(w)
    return rows.withColumn("_p", (F.col(height) > F.coalesce(before, F.lit(float("-inf")))) & (F.col(height) >= F.coalesce(after, F.lit(float("-inf")))) & (F.col(height) >= least)).where("_p").drop("_p")
