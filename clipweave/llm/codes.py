"""Vector code compression: product codes, with nearest entries found by an integer Walsh-Hadamard transform.

A vector of whole numbers is cut into parts, and each part is named by the nearest entry of its place's codebook. The transform of
the difference of a part and an entry, zero-padded to a power of two m, has m times its squared length. Its coefficients are
taken in sequency order, where smooth parts have most of their length in the first; an entry whose sum of scaled squares has passed
that of the most likely entry is out. All sums are of whole numbers: of longs while they cannot overflow, else of Python's own.

Codebooks are learned by rounds of assignment and integer means. A round is one pass over the vectors: tasks send a sum for each
entry and place, which meet by aggregation, so that the driver holds codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: What a component is held to, and where sums of longs are safe.
LIMIT, SAFE = 1 << 62, 1 << 62
_MAX = (1 << 63) - 1
#: Labels with over one in so many of the rows get their totals by broadcast: at most so many of them.
HEAVY_LABELS = 1_000


def sequency(m: int) -> np.ndarray:
    """For each number of sign changes, the row of the natural Hadamard matrix of order ``m`` (a power of two) that has it."""
    k = np.arange(m)
    gray, out = k ^ (k >> 1), np.zeros(m, np.int64)
    for _ in range(m.bit_length() - 1):
        out, gray = out << 1 | gray & 1, gray >> 1
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows of ``x``, zero-padded to a power of two, coefficients by sequency."""
    m = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.concatenate([x, np.zeros((len(x), m - x.shape[1]), x.dtype)], axis=1)
    step = 1
    while step < m:
        y = y.reshape(len(x), -1, 2, step)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        step *= 2
    return y.reshape(len(x), m)[:, sequency(m)]


def nearest(x: np.ndarray, entries: np.ndarray, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of ``x``, ties to the lower index; both are whole numbers.

    ``looked``, if given, gets the number of coefficients that were compared, of all that there are.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    m = 1 << max(0, x.shape[1] - 1).bit_length()
    if 4 * m * m * top * top >= SAFE:
        x, entries = x.astype(object), entries.astype(object)
    w, c = hadamard(x), hadamard(entries)
    part = (w[:, :1] - c[None, :, 0]) ** 2
    lead = part.argmin(axis=1)
    bar = ((w - c[lead]) ** 2).sum(axis=1)
    row, col = np.nonzero(part <= bar[:, None])
    part = part[row, col]
    seen = part.size and len(x) * (len(entries) + m)
    for k in range(1, m):
        part = part + (w[row, k] - c[col, k]) ** 2
        seen += len(row)
        in_ = (part <= bar[row]).astype(bool)
        row, col, part = row[in_], col[in_], part[in_]
    if looked is not None:
        looked += [int(seen), len(x) * len(entries) * m]
    head = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(part, head)
    best = np.flatnonzero((part == least[row]).astype(bool))
    return col[best[np.searchsorted(row[best], np.arange(len(x)))]], least // m


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part as whole numbers: entries[part][index][place]."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    scale: float

    def array(self, part: int) -> np.ndarray:
        return np.array(self.entries[part], np.int64).reshape(len(self.entries[part]), -1)

    def text(self) -> str:
        return ",".join(str(v) for part in self.entries for entry in part for v in entry)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _whole(scale: float):
    """Batches of (vec_id, label, v) with v as floor(scale * x), held to LIMIT."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column(2)
            with np.errstate(over="ignore"):
                value = np.floor(np.asarray(column.flatten(), np.float64) * scale)
            whole = np.where(np.abs(value) < LIMIT, value, 0).astype(np.int64)
            whole = np.where(np.abs(value) < LIMIT, whole, np.where(value > 0, LIMIT, -LIMIT))
            sizes = np.asarray(column.value_lengths(), np.int64)
            yield batch.set_column(2, "v", pa.ListArray.from_arrays(np.cumsum(np.r_[0, sizes]).astype(np.int32), pa.array(whole)))

    return go


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(vector, part, place): vectors as rows, shorter ones with zeros at their ends."""
    flat, sizes = np.asarray(column.flatten(), np.int64), np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(column), parts * width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(column), parts, width)


def _summer(books: Codebooks, width: int):
    """One row for each part, entry and place that a task has met: how often, and the sum there."""
    parts = len(books.entries)

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in it:
            x = _parts(batch.column(2), parts, width)
            for p in range(parts):
                index, _ = nearest(x[:, p], books.array(p))
                own = x[:, p] if int(np.abs(x[:, p]).max(initial=0)) * len(x) < SAFE else x[:, p].astype(object)
                order = np.argsort(index, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0]) if len(x) else []
                sums = np.add.reduceat(own[order], heads, axis=0) if len(x) else []
                for e, s, n in zip(index[order][heads].tolist() if len(x) else [], sums, np.diff(np.r_[heads, len(x)]).tolist(), strict=False):
                    have = total.setdefault((p, e), [0] * (width + 1))
                    for k, v in enumerate((n, *s.tolist())):
                        have[k] += v
        rows = [(p, e, k - 1, v) for (p, e), have in total.items() for k, v in enumerate(have)]
        columns = [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)] + [pa.array([str(r[3]) for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "total"])

    return go


def _namer(books: Codebooks, width: int):
    parts = len(books.entries)

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _parts(batch.column(2), parts, width)
            found = [nearest(x[:, p], books.array(p)) for p in range(parts)]
            codes = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
            errors = [min(_MAX, sum(row)) for row in zip(*(d.tolist() for _, d in found), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return go


def whole_vectors(vectors: DataFrame, *, scale: float = 4096.0, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(vec_id, label, v): usable vectors as whole numbers floor(scale * x), those beyond 2**62 held to it."""
    mark = F.col(label) if label else F.lit(None).cast("int")
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), mark.alias("label"), F.col(vector).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    schema = f"vec_id long, label {own.schema['label'].dataType.simpleString()}, v array<long>"
    return own.mapInArrow(_whole(scale), schema)


def fit(whole: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> tuple[Codebooks, int]:
    """Codebooks learned from (vec_id, label, v) of ``whole_vectors``, and the places of a part.

    Codebooks start as the parts of the vectors of the ``entries`` smallest ids, nulls last, ties to the smaller vector. Each round
    takes every vector, and replaces each used entry by the floor of the mean of its parts, place by place.
    """
    longest = whole.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    first = [r["v"] + [0] * (parts * width - len(r["v"])) for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    books = Codebooks(tuple(tuple(tuple(v[p * width : (p + 1) * width]) for v in first) for p in range(parts)), scale)
    for _ in range(rounds if first and width else 0):
        sums = whole.mapInArrow(_summer(books, width), "part int, entry int, place int, total string")
        met = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in met}
        moved = lambda p, e, old: tuple(total[p, e, k] // total[p, e, -1] for k in range(width)) if (p, e, -1) in total else old  # noqa: B023, E731
        books = Codebooks(tuple(tuple(moved(p, e, old) for e, old in enumerate(part)) for p, part in enumerate(books.entries)), scale)
    return books, width


def encode(whole: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance to what the code stands for, at most 2**63 - 1."""
    schema = f"vec_id long, label {whole.schema['label'].dataType.simpleString()}, code string, error long"
    return whole.mapInArrow(_namer(books, width), schema)


def decode(codes: DataFrame, books: Codebooks, length: int) -> DataFrame:
    """``codes`` with ``approx``: the vector of ``length`` that a code stands for, in the middle of each step of the scale."""
    flat = [[[(v + 0.5) / books.scale for v in entry] for entry in part] for part in books.entries]
    table = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in part)) for part in flat))
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    pieces = [F.get(F.get(table, F.lit(p)), at(p)) for p in range(len(flat))]
    return codes.withColumn("approx", F.slice(F.concat(*pieces), 1, length))


def with_label_error(codes: DataFrame, *, heavy: int = HEAVY_LABELS) -> DataFrame:
    """``codes`` with ``label_error``, the errors of its label added up; nulls are one label.

    Labels that one in ``heavy`` rows has, which are at most so many, meet their rows by broadcast, so that no task gets all rows of one.
    """
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n"))
    totals = cut(totals.withColumn("label_error", F.least("_sum", F.lit(_MAX).cast("decimal(38,0)")).cast("long")), "label-errors")
    bar = (totals.agg(F.sum("_n")).first()[0] or 0) / heavy
    same = F.col("label").eqNullSafe(F.col("_label"))
    few, many = (totals.where(F.col("_n") > bar if big else F.col("_n") <= bar).select("_label", "label_error") for big in (True, False))
    # At most ``heavy`` labels have over one in ``heavy`` rows each.
    common = codes.join(F.broadcast(few), same).drop("_label")
    rare = codes.join(F.broadcast(few.select("_label")), same, "left_anti").join(many, same).drop("_label")
    return common.unionByName(rare)


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error, label_error), codebooks) of all usable vectors.

    Vectors that are null or hold null or non-finite components are left out. Rows without an id and repeated rows are coded like all
    others; ids only choose the first entries. Vectors shorter than the longest one end in zeros, and so does a last part that
    is not full; empty vectors are all zeros. With fewer vectors than entries the codebooks are as small. An empty table gives
    no rows and empty codebooks. Extra columns play no part.
    """
    whole = cut(whole_vectors(vectors, scale=scale, vec_id=vec_id, vector=vector, label=label), "whole-vectors")
    books, width = fit(whole, parts=parts, entries=entries, rounds=rounds, scale=scale)
    return with_label_error(cut(encode(whole, books, width), "codes")), books
