"""Peaks of series of any length by height, distance and prominence.

A series is cut into chunks of equal length. Within one a stack of falling values gives each peak's valleys up to the next higher ground; where that
lies beyond, the chunks' highest and lowest values tell in which chunk it is, and only that chunk is looked into once more. Spacing is settled
within islands of peaks that are near enough to disturb each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.jobs import written
from .prefix import with_before, with_number

CHUNK = 65_536


def valleys(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest value between each place of ``at`` and the next higher value before it, or the start; whether there is no higher one)."""
    want, low, none = {k: n for n, k in enumerate(at.tolist())}, np.zeros(len(at)), np.zeros(len(at), bool)
    stack: list[tuple[float, float]] = []  # values not yet passed by a higher one, each with the lowest since the one below it
    for k, v in enumerate(x.tolist()):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        if k in want:
            low[want[k]], none[want[k]] = least, not stack
        stack.append((v, least))
    return low, none


def _runs(it: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows of each (sorted) key, put together once."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not len(batch):
            continue
        names = np.stack([np.asarray(batch.column(k), np.int64) for k in keys], axis=1)
        edge = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1), True])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and any(held[0].column(k)[0].as_py() != names[a, n] for n, k in enumerate(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _in_chunks(height: float, size: int):
    """Peaks of chunks (key, chunk, pos, t, x), which come with a row of each neighbour, and a row that sums each chunk up: its t is null, low and high its extremes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(it, ("key", "chunk")):
            key, chunk = c.column("key")[0].as_py(), c.column("chunk")[0].as_py()
            pos, t, x = (np.asarray(c.column(n)) for n in ("pos", "t", "x"))
            own = pos // size == chunk
            peak = np.zeros(len(x), bool)
            peak[1:-1] = (x[:-2] < x[1:-1]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)
            y, at = x[own], np.flatnonzero(peak[own])
            left, no_left = valleys(y, at)
            right, no_right = valleys(y[::-1], len(y) - 1 - at)
            n = len(at) + 1
            columns = {
                "key": pa.array([key] * n, pa.int64()), "chunk": pa.array([chunk] * n, pa.int64()), "pos": pa.array([*pos[own][at].tolist(), None], pa.int64()), "t": pa.array([*t[own][at].tolist(), None], pa.int64()),
                "x": pa.array([*y[at].tolist(), None], pa.float64()), "low": pa.array([*left.tolist(), float(y.min())], pa.float64()), "high": pa.array([*right.tolist(), float(y.max())], pa.float64()),
                "no_left": pa.array([*no_left.tolist(), None], pa.bool_()), "no_right": pa.array([*no_right.tolist(), None], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def spaced(pos: np.ndarray, x: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks at ``pos``, in order, stay: from the highest on, of equal ones the later, each drives out those nearer than ``distance``."""
    stay = np.ones(len(pos), bool)
    for k in np.lexsort((-pos, -x)).tolist():
        if stay[k]:
            a, b = np.searchsorted(pos, pos[k] - distance, side="right"), np.searchsorted(pos, pos[k] + distance)
            stay[a:k] = False
            stay[k + 1 : b] = False
    return stay


def _islands(distance: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(it, ("key", "island")):
            keep = spaced(np.asarray(c.column("pos")), np.asarray(c.column("x")), distance)
            yield from c.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _looked_into(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The valley within a chunk between its side that faces the peak and the higher value nearest to it."""
    y = np.asarray(rows.column("x"))[np.argsort(np.asarray(rows.column("pos")), kind="stable")] if rows.num_rows else np.zeros(0)
    out = []
    for x, left in zip(asked.column("x").to_pylist(), asked.column("left").to_pylist(), strict=True):
        higher = np.flatnonzero(y > x)
        part = y[higher[-1] + 1 :] if left else y[: higher[0]]
        out.append(float(part.min()) if len(part) else None)
    return pa.table({"key": asked.column("key"), "pos": asked.column("pos"), "left": asked.column("left"), "valley": pa.array(out, pa.float64())})


def spaced_peaks(rows: DataFrame, *, height: float, distance: int, prominence: float, bucket: int = 1 << 20, chunk: int = CHUNK) -> DataFrame:
    """(key, t, x): peaks of series (key, t, x): local maxima at least ``height`` high and ``prominence`` above the higher of the two valleys
    to the next higher ground; of peaks fewer than ``distance`` places apart the highest stays (of equal ones the later).

    ``t`` is a whole number and orders a series; ``bucket`` is how much of it is numbered at a time, ``chunk`` (2 or more) how many places a task holds. Null keys, times and values take no part; the first and the last
    place are no peaks, nor is a flat stretch but for its first place. Times of a key are not repeated.
    """
    own = rows.select(F.col("key").cast("long").alias("key"), F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x")).dropna()
    placed = with_number(own, "key", F.floor(F.col("t") / bucket), ["t"], "pos").withColumn("chunk", F.floor(F.col("pos") / chunk))
    seam = F.when(F.col("pos") % chunk == 0, F.array(F.lit(0), F.lit(-1))).when(F.col("pos") % chunk == chunk - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    around = placed.withColumn("_seam", F.explode(seam)).withColumn("chunk", F.col("chunk") + F.col("_seam")).where("chunk >= 0").select("key", "chunk", "pos", "t", "x")
    # A chunk of nothing but its neighbour's row, beyond the end, is none.
    full = around.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "pos")
    schema = "key long, chunk long, pos long, t long, x double, low double, high double, no_left boolean, no_right boolean"
    found = written(full.mapInArrow(_own_chunks(_in_chunks(height, chunk), chunk), schema), "peaks-found")
    peaks, chunks = found.where("t is not null"), found.where("t is null")

    by = F.floor(F.col("pos") / bucket)
    last = with_before(peaks, "key", by, ["pos"], maxima={"_last": F.col("pos")})
    starts = last.withColumn("_new", F.coalesce(F.col("pos") - F.col("_last") >= distance, F.lit(True)).cast("long")).drop("_last")
    named = with_before(starts, "key", by, ["pos"], sums={"_islands": F.col("_new")}).withColumn("island", F.col("_islands") + F.col("_new"))
    named = named.select("key", "island", *(c for c in peaks.columns if c != "key"))
    kept = named.repartition("key", "island").sortWithinPartitions("key", "island", "pos").mapInArrow(_islands(distance), named.schema)
    kept = written(kept, "peaks-kept")

    table = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "low", "high"))).alias("c"))  # one entry for each ``chunk`` places
    open_ = kept.where("no_left or no_right").join(table, "key")
    sides = F.explode(F.filter(F.array(F.struct(F.lit(True).alias("left"), F.col("no_left").alias("yes")), F.struct(F.lit(False).alias("left"), F.col("no_right").alias("yes"))), lambda s: s["yes"]))
    open_ = open_.withColumn("_side", sides).withColumn("left", F.col("_side.left"))
    beyond = F.filter("c", lambda z: F.when(F.col("left"), z["chunk"] < F.col("chunk")).otherwise(z["chunk"] > F.col("chunk")))
    higher = F.filter(beyond, lambda z: z["high"] > F.col("x"))
    goal = F.when(F.col("left"), F.array_max(F.transform(higher, lambda z: z["chunk"]))).otherwise(F.array_min(F.transform(higher, lambda z: z["chunk"])))
    open_ = open_.withColumn("goal", goal).withColumn("_beyond", beyond)
    between = F.filter("_beyond", lambda z: F.col("goal").isNull() | F.when(F.col("left"), z["chunk"] > F.col("goal")).otherwise(z["chunk"] < F.col("goal")))
    open_ = open_.select("key", "pos", "x", "left", "goal", F.array_min(F.transform(between, lambda z: z["low"])).alias("middle"))
    asked = open_.where("goal is not null").select("key", F.col("goal").alias("chunk"), "pos", "x", "left")
    there = placed.join(asked.select("key", "chunk").distinct(), ["key", "chunk"], "left_semi").select("key", "chunk", "pos", "x")
    inner = there.groupBy("key", "chunk").cogroup(asked.groupBy("key", "chunk")).applyInArrow(_looked_into, "key long, pos long, left boolean, valley double")
    more = open_.select("key", "pos", "left", F.col("middle").alias("valley")).unionByName(inner).groupBy("key", "pos").agg(_least_where(True), _least_where(False))
    out = kept.join(more, ["key", "pos"], "left")
    floor = F.greatest(F.least("low", "_left"), F.least("high", "_right"))
    return out.where(F.col("x") - floor >= prominence).select("key", "t", "x")


def _least_where(left: bool) -> Column:
    return F.min(F.when(F.col("left") == left, F.col("valley"))).alias("_left" if left else "_right")


def _own_chunks(inner, size: int):
    """``inner`` without the chunks that hold only a neighbour's row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def real() -> Iterator[pa.RecordBatch]:
            for c in _runs(it, ("key", "chunk")):
                if (np.asarray(c.column("pos")) // size == c.column("chunk")[0].as_py()).any():
                    yield from c.to_batches()

        yield from inner(real())

    return run
