"""Distances and energies of series and histograms as columns over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def unit(h: Column) -> Column:
    """Histogram with sum 1; one without mass is uniform."""
    return F.when(total(h) > 0, F.transform(h, lambda x: x / total(h))).otherwise(F.transform(h, lambda x: 1.0 / F.size(h)))


def running(a: Column) -> Column:
    return F.transform(a, lambda _, i: total(F.slice(a, 1, i + 1)))


def cdf_l1(a: Column, b: Column) -> Column:
    """Sum of the distances of two cumulative histograms."""
    return total(F.zip_with(running(a), running(b), lambda x, y: F.abs(x - y)))


def circular_emd(a: Column, b: Column, bins: int) -> Column:
    """Least ``cdf_l1`` over the rotations of ``b``."""
    turned = [F.concat(F.slice(b, k + 1, bins - k), F.slice(b, 1, k)) if k else b for k in range(bins)]
    return F.array_min(F.array(*(cdf_l1(a, t) for t in turned)))


def quantile(sorted_values: Column, p: Column) -> Column:
    """Quantile with linear interpolation of a sorted array."""
    at = p * (F.size(sorted_values) - 1)
    low = F.floor(at).cast("int")
    x, y = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return x + (y - x) * (at - low)


def quantile_w1(a: Column, b: Column) -> Column:
    """Mean distance of the quantiles of two sorted arrays at as many equal steps as the longer has values."""
    n = F.greatest(F.size(a), F.size(b))
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n > 1, i / (n - 1)).otherwise(0.0))
    return total(F.transform(steps, lambda p: F.abs(quantile(a, p) - quantile(b, p)))) / n


def exp_score(distance: Column, rate: float) -> Column:
    return 100 * F.exp(-rate * distance)


def l1_shares(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Mean distance of two vectors as shares of their sums: negative entries count 0, and one without mass is uniform."""

    def shares(x: Column) -> Column:
        cut = F.transform(x, lambda y: F.greatest(y, F.lit(0.0)))
        some = F.when(total(cut) > 0, cut).otherwise(F.transform(x, lambda _: F.lit(1.0)))
        return F.transform(some, lambda y: y / (total(some) + eps))

    return total(F.zip_with(shares(a), shares(b), lambda x, y: F.abs(x - y))) / F.size(a)
