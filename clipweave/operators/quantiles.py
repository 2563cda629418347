"""Exact quantiles of groups of any size: ranks are narrowed down by histograms, of which a pass keeps a fixed number of buckets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a pass, rows up to which Spark's own exact percentile takes a group, and how many groups may be larger at most.
BUCKETS, LIMIT, LARGE = 1_024, 10_000, 100_000


def exact_quantiles(rows: DataFrame, key: str, value: str, ps: list[float], *, limit: int = LIMIT) -> DataFrame:
    """(key, p, quantile): quantiles with linear interpolation of the finite values of each key; keys without any have no row.

    Groups of over ``limit`` rows, and over one in 100,000 of all, of which there are at most so many, are narrowed down together: a pass counts the values of each
    bucket between the bounds of a rank, and the bounds of the bucket that holds the rank are the next ones, until they are one value. A null key
    is a key of its own.
    """
    own = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    sizes = own.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bar = max(limit, total // LARGE)
    every = F.explode(F.array(*map(F.lit, ps)))
    large = sizes.where(F.col("n") > bar)
    at = F.col("p") * (F.col("n") - 1)
    asked = large.withColumn("p", every).withColumn("share", at - F.floor(at)).withColumn("rank", F.floor(at).cast("long"))
    asked = asked.withColumn("rank", F.explode(F.array(F.col("rank"), F.least(F.col("rank") + 1, F.col("n") - 1))))
    asked = asked.select("key", "rank", "lo", "hi", F.lit(0).cast("long").alias("before")).distinct()
    bounds = {(r["key"], r["rank"]): r for r in asked.collect()}  # two for each p of the large groups
    spark = rows.sparkSession
    found = asked
    while any(r["lo"] < r["hi"] for r in bounds.values()):
        open_ = spark.createDataFrame([r for r in bounds.values() if r["lo"] < r["hi"]], asked.schema)
        inside = own.join(F.broadcast(open_.withColumnRenamed("key", "_key")), F.col("key").eqNullSafe(F.col("_key")) & F.col("v").between(F.col("lo"), F.col("hi")))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))
        counted = inside.groupBy("key", "rank", "before", bucket.alias("b")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("m").over(Window.partitionBy("key", "rank").orderBy("b"))  # BUCKETS rows at most
        placed = counted.withColumn("after", F.col("before") + upto).withColumn("before", F.col("after") - F.col("m"))
        for r in placed.where("before <= rank and rank < after").select(asked.columns).collect():
            bounds[r["key"], r["rank"]] = r
    found = spark.createDataFrame(list(bounds.values()), asked.schema).select("key", "rank", F.col("lo").alias("x"))
    ranks = large.withColumn("p", every).withColumn("low", F.floor(at).cast("long")).withColumn("share", at - F.col("low"))
    side = lambda n: F.broadcast(found.select(F.col("key").alias(f"_{n}"), F.col("rank").alias(f"r_{n}"), F.col("x").alias(n)))
    joined = ranks.join(side("a"), F.col("key").eqNullSafe(F.col("_a")) & (F.col("low") == F.col("r_a")))
    joined = joined.join(side("b"), F.col("key").eqNullSafe(F.col("_b")) & (F.least(F.col("low") + 1, F.col("n") - 1) == F.col("r_b")))
    of_large = joined.select("key", "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("quantile"))
    few = own.join(F.broadcast(large.select(F.col("key").alias("_key"))), F.col("key").eqNullSafe(F.col("_key")), "left_anti")
    parts = few.groupBy("key").agg(F.percentile("v", F.array(*map(F.lit, ps))).alias("q"))
    of_few = parts.select("key", F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("q").alias("q"))).alias("z")).select("key", "z.p", F.col("z.q").alias("quantile"))
    return functools.reduce(DataFrame.unionByName, [of_large, of_few])
