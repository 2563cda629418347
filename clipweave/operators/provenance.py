"""Provenance of results: one hash of all inputs, in steps of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids, or hashes, that one row gathers.
STEP = 4096


def provenance(rows: DataFrame, result: str, input_id: str) -> DataFrame:
    """(result, provenance, n): sha256 over the inputs' ids in order, taken by ranges of ids, of these by ranges again, and of all of them."""
    joined = lambda x, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(x).cast("string").alias("x")))), lambda p: p["x"]), ","), 256)
    ids = rows.select(result, F.col(input_id).alias("_id")).withColumn("_part", F.expr(f"_id div {STEP}"))
    part = ids.groupBy(result, "_part").agg(joined("_id", "_id").alias("_h"), F.count("*").alias("n")).withColumn("_far", F.expr(f"_part div {STEP}"))
    far = part.groupBy(result, "_far").agg(joined("_h", "_part").alias("_h"), F.sum("n").alias("n"))
    return far.groupBy(result).agg(joined("_h", "_far").alias("provenance"), F.sum("n").alias("n"))
