"""Files that Spark has no reader for, parsed on the executors out of their bytes: feature caches of NumPy and CSV of several encodings."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURES = "path string, name string, shape array<int>, values array<double>, error string"
#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "gbk")


def _bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content); ``glob`` picks files by their names while they are listed."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def _arrays(required: tuple[str, ...]):
    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                arrays = {n: np.asarray(z[n]) for n in z.files}
        except Exception as e:  # noqa: BLE001  whatever is wrong with a file is told, and the others are read
            yield path, None, None, None, f"no arrays: {type(e).__name__}"
            return
        if missing := [n for n in required if n not in arrays]:
            yield path, None, None, None, f"missing: {', '.join(missing)}"
            return
        for name, a in arrays.items():
            if a.dtype.kind in "biuf":
                yield path, name, list(a.shape), a.astype(np.float64).ravel().tolist(), None
            else:
                yield path, name, list(a.shape), None, f"no numbers: {a.dtype}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string())
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(rows(path, content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=["path", "name", "shape", "values", "error"])

    return run


def read_features(spark: SparkSession, path: str, *, required: tuple[str, ...] = (), sample: str | None = None) -> DataFrame:
    """(sample_id, path, name, shape, values, error): the arrays of NPZ files, values row by row.

    A file without one of the ``required`` arrays, or that holds none, gives one row that says so, and arrays of other things than numbers one each.
    ``sample``, a file's name without its end, or a pattern of such names, is looked for while files are listed: others are not opened.
    """
    found = _bytes(spark, path, f"{sample or '*'}.npz").repartition(F.col("path")).mapInArrow(_arrays(tuple(required)), _FEATURES)
    name = F.regexp_extract("path", r"([^/]*)\.npz$", 1)
    return found.select(F.url_decode(name).alias("sample_id"), "path", "name", "shape", "values", "error")


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = content.as_py()
            for encoding in ENCODINGS:
                try:
                    text = raw.decode(encoding)
                    break
                except UnicodeDecodeError:
                    text = ""
            header, out = None, []
            for line in csv.reader(io.StringIO(text, newline="")):
                if header is None:
                    header = list(dict.fromkeys(line))  # of names that a header repeats the first stands
                    at = [line.index(n) for n in header]
                elif line:
                    out.append([(n, line[k] if k < len(line) and line[k] != "" else None) for n, k in zip(header, at, strict=True)])
            columns = [pa.array([path] * len(out), pa.string()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "k", "cells"])


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, each of UTF-8 with or without a mark, or else of GBK, as one table of texts: columns that a file lacks, and empty cells, are null.

    Every file is read once, by one task; what goes to the driver is the names of the columns. A file that is neither, or has no rows, adds none.
    """
    cells = _bytes(spark, path).mapInArrow(_cells, "path string, k long, cells map<string,string>")
    names = [r["n"] for r in cells.select(F.explode(F.map_keys("cells")).alias("n")).distinct().collect()]
    return cells.select(*(F.col("cells")[n].alias(n) for n in sorted(names)))
