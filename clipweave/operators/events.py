"""Event scores of matched events: weighted quality, relations, coverage, and their total.

Matches are (key, ref_id, gen_id, q); events of either side (key, id, s, e) in seconds. Pairs of matches meet within a key, which is one clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.event_total import event_total
from ..streaming.jobs import written


def matched_quality(matches: DataFrame, refs: DataFrame, *, rho: float = 0.5) -> DataFrame:
    """(key, n, ega): quality of matches weighted by the reference's duration to the power ``rho``, in percent; events without length do not count."""
    m = matches.join(refs.select("key", F.col("id").alias("ref_id"), (F.col("e") - F.col("s")).alias("_d")), ["key", "ref_id"]).where("_d > 0")
    w = F.pow("_d", F.lit(rho))
    return m.groupBy("key").agg(F.count("*").alias("n"), (100 * F.sum(w * F.col("q")) / F.sum(w)).alias("ega"))


def relations(matches: DataFrame, refs: DataFrame, gens: DataFrame) -> DataFrame:
    """(key, n_relations, erel): how alike the relations of every two matches are on both sides, in percent; keys with fewer have no row.

    The first of two matches is the one whose reference begins first.
    """
    side = lambda t, c: t.select("key", F.col("id").alias(f"{c}_id"), F.col("s").alias(f"{c}s"), F.col("e").alias(f"{c}e"))
    m = matches.select("key", "ref_id", "gen_id").join(side(refs, "ref"), ["key", "ref_id"]).join(side(gens, "gen"), ["key", "gen_id"])
    other = m.select("key", *(F.col(c).alias(f"{c}2") for c in m.columns if c != "key"))
    two = m.join(other, "key").where("struct(refs, ref_id) < struct(refs2, ref_id2)")
    r, g = (iv.allen(F.col(f"{c}s"), F.col(f"{c}e"), F.col(f"{c}s2"), F.col(f"{c}e2")) for c in ("ref", "gen"))
    two = two.withColumns({"_r": r, "_g": g})
    return two.groupBy("key").agg(F.count("*").alias("n_relations"), (100 * F.avg(iv.affinity(F.col("_r"), F.col("_g")))).alias("erel"))


def coverage(matches: DataFrame, refs: DataFrame, gens: DataFrame) -> DataFrame:
    """(key, coverage, prec, redundancy, ecr) of every key that either side has."""
    count = lambda t, c: t.groupBy("key").agg(F.count("*").alias(c))
    n = count(refs, "n_ref").join(count(gens, "n_gen"), "key", "full").join(count(matches, "m"), "key", "left").fillna(0, ["n_ref", "n_gen", "m"])
    share = lambda c: F.coalesce(F.try_divide(F.col("m"), F.col(c)), F.lit(0.0))
    n = n.withColumns({"coverage": share("n_ref"), "prec": share("n_gen")})
    both = F.col("coverage") + F.col("prec")
    return n.select("key", "coverage", "prec", (1 - F.col("prec")).alias("redundancy"), F.when(both > 0, 200 * F.col("coverage") * F.col("prec") / both).otherwise(0.0).alias("ecr"))


def event_scores(matches: DataFrame, refs: DataFrame, gens: DataFrame, *, rho: float = 0.5) -> DataFrame:
    """(key, ega, erel, ecr, s_event); ``erel`` is null where there are fewer than two matches, and its weight then goes to the others."""
    matches = written(matches, "event-matches")  # used four times
    out = coverage(matches, refs, gens).join(matched_quality(matches, refs, rho=rho).drop("n"), "key", "left").join(relations(matches, refs, gens).drop("n_relations"), "key", "left")
    return out.withColumn("s_event", event_total(F.col("ega"), F.col("erel"), F.col("ecr")))
