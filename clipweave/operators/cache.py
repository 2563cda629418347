"""Results kept between runs by content: each different (purpose, configuration, text) is worked out once, whoever asks again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.jobs import place_of


def content_key(purpose: Column, text: Column, config: str) -> Column:
    """256 bits of purpose, configuration and text, each with its length, so that no two triples run together."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(F.coalesce(purpose, F.lit(""))), part(F.lit(config)), part(text)), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _stored(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """(key, result): of a key that two runs have added the least result."""
    raw = spark.read.schema(f"key string, result {schema}").parquet(f"{store}/results") if _exists(spark, f"{store}/results") else spark.createDataFrame([], f"key string, result {schema}")
    return raw.groupBy("key").agg(F.min("result").alias("result"))


def with_cached(texts: DataFrame, work: Callable[[DataFrame], DataFrame], store: str, *, config: str, schema: str = "array<double>") -> DataFrame:
    """``texts`` (purpose, text, ..) with ``result`` and ``fresh``: what ``work`` makes of each different text, and whether this run has made it.

    ``work`` gets (key, purpose, text) of what the folder ``store`` does not have yet, each once, and returns (key, result), which is added there in one write. Another
    ``config`` is other content. Null texts have no result. A run that dies leaves the store as it was; two at a time may both work on a text, and
    the store then has it twice, which changes nothing.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("_key", F.when(F.col("text").isNotNull(), content_key(F.col("purpose"), F.col("text"), config)))
    wanted = keyed.where("_key is not null").select(F.col("_key").alias("key"), "purpose", "text").dropDuplicates(["key"])
    missing = wanted.join(_stored(spark, store, schema).select("key"), "key", "left_anti")
    fresh_at = place_of(spark, "fresh")
    work(missing).select("key", "result").write.parquet(fresh_at)  # read again below, and once more for the store
    fresh = spark.read.schema(f"key string, result {schema}").parquet(fresh_at)
    if fresh.head(1):
        fresh.write.mode("append").parquet(f"{store}/results")
    known = _stored(spark, store, schema).select(F.col("key").alias("_key"), "result")
    new = fresh.select(F.col("key").alias("_key"), F.lit(True).alias("fresh")).distinct()
    return keyed.join(known, "_key", "left").join(new, "_key", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))).drop("_key")


def compacted(spark: SparkSession, store: str, path: str, *, schema: str = "array<double>", files: int = 8) -> None:
    """Write the store anew at ``path``, each key once, in a few files."""
    _stored(spark, store, schema).repartition(files, "key").write.parquet(f"{path}/results")
