"""Writers: score tables with fixed places, by class, reports with their status, merged events in four tables, chunks of workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def six_places(scores: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as text with six decimals; null stays null."""
    return scores.withColumns({c: F.format_string("%.6f", F.col(c).cast("double")) if c in columns else F.col(c) for c in scores.columns} | {c: F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c).cast("double"))) for c in columns})


def append_scores(scores: DataFrame, path: str, columns: list[str], by: str = "modelname") -> None:
    """Append CSV files, one folder for each value of ``by``, headers in every file; the whole folder is the table of all."""
    six_places(scores, columns).write.mode("append").option("header", True).partitionBy(by).csv(path)


def write_boards(merged: DataFrame, path: str, scores: list[str]) -> None:
    """The wide table of samples and the averages of models over what they have."""
    merged.write.mode("overwrite").option("header", True).csv(f"{path}/samples")
    average = merged.groupBy("modelname").agg(F.count("sample_id").alias("count_sample_id"), *(F.avg(c).alias(c) for c in scores))
    average.write.mode("overwrite").option("header", True).csv(f"{path}/models")


def with_status(reports: DataFrame, *, missing: str, error: str, reused: str) -> DataFrame:
    """``reports`` with ``status``: error, missing, reused or ok; the three are conditions in SQL, tested in that order."""
    return reports.withColumn("status", F.expr(f"case when {error} then 'error' when {missing} then 'missing' when {reused} then 'reused' else 'ok' end"))


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines, a folder for each status."""
    reports.write.mode("overwrite").partitionBy("status").json(path)


def write_merged(clusters: DataFrame, placed: DataFrame, texts: DataFrame, centroids: DataFrame, path: str) -> None:
    """Events, texts, vectors and the map of members of merged clips, as four tables of one run."""
    for name, t in (("events", clusters.drop("members")), ("texts", texts), ("vectors", centroids), ("merge_map", placed.where("cluster is not null"))):
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def merge_chunks(old: DataFrame | None, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those of new chunks, columns of either, one row for each key: the old one, else the first of the chunks by their other columns."""
    both = chunks.withColumn("_prio", F.lit(1)) if old is None else old.withColumn("_prio", F.lit(0)).unionByName(chunks.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_prio")]
    w = Window.partitionBy(*keys).orderBy("_prio", *rest)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_prio")


def without_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` less the rows of the keys in ``gone``: a delete, to be written as a new version."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """``without_keys`` of a table and of all that hang on it by the same keys."""
    return {name: without_keys(t, gone, keys) for name, t in tables.items()}


def done_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Keys of the rows that a CSV table already has."""
    return spark.read.option("header", True).csv(path).select(*keys).distinct()
