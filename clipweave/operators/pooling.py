"""Weighted sums of vectors by key: added up in each task before the shuffle, one row for each key and task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task adds up at a time, and parts of a key that are added up apart.
STEP, SALTS = 50_000, 32


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, w, x) as rows (key, total of w, sum of w * x), keys of a step once; the vectors of a key in one step have one length or stand apart."""
    held, n = [], 0
    for batch in it:
        held.append(batch)
        n += len(batch)
        if n >= STEP:
            yield _added(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _added(pa.Table.from_batches(held))


def _added(t: pa.Table) -> pa.RecordBatch:
    column = t.column("x").combine_chunks()
    code, w = np.asarray(t.column("code"), np.int64), np.asarray(t.column("w"), np.float64)
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat, ends = np.asarray(column.flatten(), np.float64), np.cumsum(sizes)
    keys, first, weights, sums, lengths = t.column("key").combine_chunks(), [], [], [], []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        x = flat[(ends[rows] - size)[:, None] + np.arange(size)] * w[rows, None]
        order = np.argsort(code[rows], kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(code[rows][order]) != 0])
        first += rows[order[head]].tolist()
        weights += np.add.reduceat(w[rows][order], head).tolist()
        sums.append(np.add.reduceat(x[order], head, axis=0).ravel() if size else np.zeros(0))
        lengths.append(np.full(len(head), size))
    offsets = np.r_[0, np.cumsum(np.concatenate(lengths))] if lengths else np.zeros(1)
    values = pa.array(np.concatenate(sums) if sums else np.zeros(0), pa.float64())
    out = [keys.take(pa.array(first, pa.int64())), pa.array(weights, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)]
    return pa.RecordBatch.from_arrays(out, names=["key", "w", "x"])


def pooled(vectors: DataFrame) -> DataFrame:
    """(key, x): the direction, of length 1, of the sum of each key's vectors (key, w, x) by weight; null where it has none.

    Weights below 0 count as 0. Null weights and vectors, and vectors that hold null, take no part. Of a key whose vectors have different lengths
    the shorter ones end in zeros.
    """
    own = vectors.select("key", F.greatest(F.col("w").cast("double"), F.lit(0.0)).alias("w"), F.col("x").cast("array<double>").alias("x"))
    own = own.where("w is not null and x is not null and not exists(x, v -> v is null)").withColumn("code", F.xxhash64("key"))
    schema = f"key {own.schema['key'].dataType.simpleString()}, w double, x array<double>"
    # Within a step keys are told apart by 64 bits. What tasks send is added up once more by key and a salt, so that few rows of a key are left.
    parts = own.mapInArrow(_sums, schema).select("key", F.lit(1.0).alias("w"), "x", F.xxhash64("key").alias("code"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    parts = parts.repartition("key", "salt").drop("salt").mapInArrow(_sums, schema)
    add = lambda a, b: F.zip_with(a, b, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))
    total = parts.groupBy("key").agg(F.collect_list("x").alias("xs"))  # about one row for each salt
    summed = F.when(F.size("xs") == 1, F.get("xs", F.lit(0))).otherwise(F.aggregate("xs", F.array().cast("array<double>"), add))
    size = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v))
    # Sum and length are worked out once for a key, not for each place.
    sized = F.transform(F.array(summed), lambda x: F.struct(x.alias("x"), size(x).alias("size")))
    bound = F.transform(sized, lambda p: F.when(p["size"] > 0, F.transform(p["x"], lambda v: v / p["size"])))
    return total.select("key", F.get(bound, F.lit(0)).alias("x"))
