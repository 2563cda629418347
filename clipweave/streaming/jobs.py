"""Structured Streaming jobs: incremental counts, event-time windows and upserts by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def read_stream(spark: SparkSession, sf_dir: str, name: str, *, files: int = 16) -> DataFrame:
    """A table's files as a stream, ``files`` in a micro-batch; the schema is the table's own."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern that fits the table's own name alone, be it a file or a folder, and no neighbour of it.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def status_counts(stream: DataFrame, status: str, value: str) -> DataFrame:
    return stream.groupBy(status).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def daily_counts(stream: DataFrame, *, late: str | None = None) -> DataFrame:
    """Counts by day of ``ts`` over the full history: files come in any order, so no row is too late and the state keeps one row per day.
    With ``late`` a watermark bounds the state, and rows further behind the newest are left out."""
    timed = stream.withColumn("t", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("t", late) if late else timed
    return timed.groupBy(F.window("t", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def place_of(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for the state and results of a run."""
    return f"{shared_dir(spark)}/clipweave/stream-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, where several steps use it: it is worked out once, and a lost executor replays nothing above it."""
    path = place_of(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_available(df: DataFrame, name: str, *, mode: str) -> DataFrame:
    """Run to the end of what is there and return the result; state and results lie in the shared folder."""
    place = place_of(df.sparkSession, name)
    run_upserts_or_replace(df, place, mode)
    return df.sparkSession.read.parquet(_latest(df.sparkSession, place))


def run_upserts_or_replace(df: DataFrame, place: str, mode: str) -> None:
    """In complete mode each micro-batch is the whole result: a new version is written and then named the latest."""

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/{k:08d}")
        batch.sparkSession.createDataFrame([(k,)], "k long").coalesce(1).write.mode("overwrite").parquet(f"{place}/latest")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()


def _latest(spark: SparkSession, place: str) -> str:
    return f"{place}/out/{spark.read.parquet(f'{place}/latest').first()['k']:08d}"


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys it does not have."""
    return new if old is None else new.unionByName(old.join(new, keys, "left_anti"))


def run_upserts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Update mode: each micro-batch's changed rows are written beside those before, and the newest row of a key stands.

    A batch costs what it changes, not the table; a batch that runs again writes the same folder. Reading takes one pass
    over all versions, which ``compact`` may put into one.
    """
    spark, place = df.sparkSession, place_of(df.sparkSession, name)

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={k}")

    q = df.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return newest(spark.read.parquet(f"{place}/out"), keys)


def newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the last batch of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return versions.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")


def compact(versions: DataFrame, keys: list[str], path: str) -> None:
    """Write what stands as one table at ``path``."""
    newest(versions, keys).write.mode("overwrite").parquet(path)
