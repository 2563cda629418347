"""Registering a query with its SQL twin, and the stand-in tables that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *, recursive: bool = False):
    """Register the decorated (spark, sf_dir) -> DataFrame under its name; ``sql`` may use the shared stand-in ``iv``, and itself if ``recursive``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            first = STAND_INS.replace("with iv", "with recursive iv") if recursive else STAND_INS
            SQL[f.__name__] = first + sql.strip() if sql.lstrip().startswith(",") else sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Interval stand-in: events as [s, e] in seconds; sample = user and five days; even ids are the reference lane, odd ones the generated.
STAND_INS = """
with iv as (
  select event_id as id, user_id * 100 + floor((epoch_us(ts) / 1e6 - 1704067200.0) / 432000.0)::bigint as key, event_id % 2 as lane,
         epoch_us(ts) / 1e6 - 1704067200.0 as s, epoch_us(ts) / 1e6 - 1704067200.0 + value * 600.0 as e, event_type, value, user_id, event_id % 500 as vec_id
  from events
)
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    return ev.select(F.col("event_id").alias("id"), (F.col("user_id") * 100 + F.floor(s / 432000.0)).cast("long").alias("key"), (F.col("event_id") % 2).alias("lane"), s.alias("s"), (s + F.col("value") * 600.0).alias("e"), "event_type", "value", "user_id", (F.col("event_id") % 500).alias("vec_id"))


def lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    iv = intervals(spark, sf_dir)
    side = lambda n, c: iv.where(F.col("lane") == n).select("key", *(F.col(x).alias(f"{c}_{x}") for x in ("id", "s", "e", "vec_id", "value", "event_type")))
    return side(0, "r"), side(1, "g")


def lane_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (reference, generated) event pairs of a sample; a sample holds the events of one clip, so its pairs are few."""
    ref, gen = lanes(spark, sf_dir)
    return ref.join(gen, "key")


def r4(c, name: str):
    return F.round(c, 4).alias(name)
