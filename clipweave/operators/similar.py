"""Cosine similarity within a key by blocks: the best partners of each vector, or all pairs above a threshold, without listing the others.

Vectors of a key are dealt into blocks of bounded size by a hash of their ids, and a block of each side meets in one task. What leaves it are
its own best pairs, or those that reach the threshold, so that a large key is many groups and nothing holds all pairs of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one side of a block, and places whose product is taken before the others.
BLOCK, HEAD = 2_048, 16
_OUT = "key long, left_id long, right_id long, cosine double"


def _unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of length 1) in the order of ids; those that have no length are left out."""
    ids = np.asarray(table.column("id"), np.int64)
    x = np.asarray(table.column("x").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
    size = np.sqrt((x * x).sum(axis=1))
    order = np.argsort(ids, kind="stable")
    order = order[(size[order] > 0) & np.isfinite(size[order])]
    return ids[order], x[order] / size[order, None]


def above(a: np.ndarray, b: np.ndarray, least: float, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the pairs of unit vectors that reach ``least``. Of the first places the product is taken; what the others can add is bounded by their
    lengths, and rows and columns that cannot reach the threshold with anyone are left out before the rest. ``seen`` gets the pairs that are left."""
    rest = lambda x: np.sqrt(np.maximum(0.0, (x[:, HEAD:] ** 2).sum(axis=1)))
    bound = a[:, :HEAD] @ b[:, :HEAD].T + rest(a)[:, None] * rest(b)[None, :]
    able = bound >= least - 1e-9
    i, j = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
    if seen is not None:
        seen.append(len(i) * len(j))
    value = a[i] @ b[j].T
    r, c = np.nonzero(value >= least)
    return i[r], j[c], value[r, c]


def best(a: np.ndarray, b: np.ndarray, k: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the ``k`` nearest of ``b`` to each of ``a`` by the cosine rounded to ``places``, ties to the first."""
    value = a @ b.T
    near = np.round(value, places)
    kth = np.partition(near, near.shape[1] - k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(a), -np.inf)
    i, j = np.nonzero(near >= kth[:, None])
    order = np.lexsort((j, -near[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, np.arange(len(a)))[i] < k
    return i[first], j[first], value[i[first], j[first]]


def _by_blocks(left: DataFrame, right: DataFrame, found) -> DataFrame:
    """What ``found`` says of each two blocks of a key; sides are (key, id, x), vectors of a key of one length, others apart."""
    usable = lambda t: t.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.size("x").alias("d")).where("key is not null and id is not null and d > 0 and not exists(x, v -> v is null)")
    left, right = usable(left), usable(right)
    blocks = lambda t, c: t.groupBy("key", "d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c))
    sizes = blocks(left, "n_left").join(blocks(right, "n_right"), ["key", "d"])
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = left.join(sizes, ["key", "d"]).withColumn("lb", own("n_left")).withColumn("rb", every("n_right"))
    two = right.join(sizes, ["key", "d"]).withColumn("rb", own("n_right")).withColumn("lb", every("n_left"))

    def group(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ("key", "left_id", "right_id", "cosine")
        if not (a.num_rows and b.num_rows):
            return pa.table({n: pa.array([], pa.float64() if n == "cosine" else pa.int64()) for n in names})
        (ids, x), (others, y) = _unit(a), _unit(b)
        i, j, value = found(x, y) if len(ids) and len(others) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        key = np.full(len(i), a.column("key")[0].as_py(), np.int64)
        return pa.table(dict(zip(names, map(pa.array, (key, ids[i], others[j], value)), strict=True)))

    columns, dealt = ["key", "d", "lb", "rb", "id", "x"], ("key", "d", "lb", "rb")
    return one.select(columns).groupBy(*dealt).cogroup(two.select(columns).groupBy(*dealt)).applyInArrow(group, _OUT)


def pairs_above(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(key, left_id, right_id, cosine) of the pairs of (key, id, x) with the same key whose cosine is at least ``least``.

    Vectors that are null, empty, hold null or have no length take no part, and meet only vectors of as many places.
    """
    return _by_blocks(left, right, lambda a, b: above(a, b, least))


def best_within(left: DataFrame, right: DataFrame, k: int = 1, *, places: int = 6) -> DataFrame:
    """(key, left_id, right_id, cosine, rank): the ``k`` vectors of ``right`` nearest to each of ``left`` within its key, by the cosine rounded to ``places``,
    ties to the smaller id; as for ``pairs_above``, some take no part."""
    found = _by_blocks(left, right, lambda a, b: best(a, b, k, places))
    rank = F.row_number().over(Window.partitionBy("key", "left_id").orderBy(F.desc(F.round("cosine", places)), "right_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, n, mean): the number of pairs of a key and their mean cosine, by the sums of both sides' directions alone."""

    def total(t: DataFrame, name: str) -> DataFrame:
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        x = t.select("key", F.col("x").cast("array<double>").alias("x")).withColumn("_s", size).where("_s > 0")
        n = x.groupBy("key").agg(F.count("*").alias(f"n_{name}"))
        place = x.select("key", "_s", F.posexplode("x").alias("i", "v")).groupBy("key", "i").agg(F.sum(F.col("v") / F.col("_s")).alias(name))
        return place.join(n, "key")

    both = total(left, "a").join(total(right, "b"), ["key", "i"]).groupBy("key").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("s"))
    n = F.col("n_a") * F.col("n_b")
    return both.select("key", n.alias("n"), (F.col("s") / n).alias("mean"))
