"""Helpers that several operators share: cut points in shared storage, Arrow batches, packed rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Text that one step of a Python task holds as numbers at a time.
SLICE_BYTES = 2 << 20


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/clipweave/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> bool:
    """Delete the tables that this application has cut; to be called when the results that read them have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor replays nothing above it."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, units: float, per_task: float) -> int:
    """Partitions for ``units`` of work: never under the session's own number, more as the input grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units // per_task) + 1)


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row that is longer alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def by_key(it: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """One batch for each run of equal ``key`` columns (whole numbers) of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not len(batch):
            continue
        if held:
            batch = pa.Table.from_batches([held.pop(), batch]).combine_chunks().to_batches()[0]
        columns = [np.asarray(batch.column(c), np.int64) for c in key]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(edge, edge[1:], strict=False):
            yield batch.slice(a, b - a)
        held = [batch.slice(edge[-1])]
    yield from held


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def long_doc(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id as long and text, under those names; rows whose id is null are left out, having nothing to be reported by."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbours' hashes; what comes of several such steps still needs ``mix``."""
    out = a * _LEFT
    out += b * _RIGHT
    out ^= out >> np.uint64(32)
    return out


def window_hash(units: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` units of an array, by doubling; the last ``width - 1`` entries mean nothing."""
    n, cur = len(units), _BYTE[units] if units.dtype == np.uint8 else mix(units)
    out, done, step = None, 0, 1
    while step <= width:
        if width & step:
            if out is None:
                out = cur.copy()
            else:
                out[: max(0, n - done)] = _join(out[: max(0, n - done)], cur[done:])
            done += step
        if step * 2 <= width:
            nxt = cur.copy()
            nxt[: max(0, n - step)] = _join(cur[: max(0, n - step)], cur[step:])
            cur = nxt
        step *= 2
    return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        top = _POWERS[-1:] * np.uint64(0x9FB21C651E98DF25)
        _POWERS = np.concatenate([_POWERS, _POWERS * top])
    return _POWERS


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a text column, where each row starts and ends); nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, words before each row and in all, where each word starts): words are runs without space and \\x09-\\x0D."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    first[heads] = inside[heads]  # a word ends where its text ends
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), before, starts
    # Place in the word: distance to its start; spaces count with the word before them but add nothing.
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    value = (_BYTE[_LOWER] if lower else _BYTE)[data]
    value *= _powers(int(place.max()) + 1)[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), before, starts
