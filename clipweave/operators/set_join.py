"""Sets that are similar by Jaccard, found by what their rarest members must share, so that only such pairs are counted out; equal sets are one."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.jobs import written

#: Sets up to this size meet by several members at once, of which a pair of sizes has at most ``MOST`` choices.
SHORT, MOST = 24, 64


def _shared(least: float, n: int, m: int) -> int:
    """How many members similar sets of these sizes share at least."""
    return max(1, math.ceil(least / (1 + least) * (n + m) - 1e-9))


def _choices(sizes: list[int], least: float) -> list[tuple[int, int, bool, bool, list[int]]]:
    """(n, kind, smaller, larger, places): by which members a set of n meets those of another size; ``kind`` names the pair of sizes.

    Sets that share t members have the first k that they share among their first n - t + k, for any k up to t.
    """
    out = []
    for n, m in itertools.combinations_with_replacement(sorted(sizes), 2):
        if n < least * m - 1e-9:
            continue
        t = _shared(least, n, m)
        k = max((k for k in range(1, t + 1) if math.comb(m - t + k, k) <= MOST), default=1)
        for size, smaller, larger in {(n, True, n == m), (m, n == m, True)}:
            out += [(size, n * (SHORT + 1) + m, smaller, larger, list(c)) for c in itertools.combinations(range(size - t + k), k)]
    return out


def _short_pairs(spark: SparkSession, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of sets up to ``SHORT`` that may be similar."""
    sizes = [r["n"] for r in sets.where(F.col("n") <= SHORT).select("n").distinct().collect()]  # at most SHORT
    plan = spark.createDataFrame(_choices(sizes, least), "n int, kind int, smaller boolean, larger boolean, places array<int>")
    met = F.xxhash64("kind", F.transform("places", lambda k: F.get("members", k)))
    signed = sets.join(F.broadcast(plan), "n").select(met.alias("met"), "id", "n", "smaller", "larger")
    side = lambda role, c: signed.where(role).select("met", F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
    return side("smaller", "a").join(side("larger", "b"), "met").where("a_n < b_n or (a_n = b_n and a < b)").select("a", "b")


def _long_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of sets, one of them at least over ``SHORT``, that may be similar: they share a member of both prefixes."""
    head = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    prefix = sets.where(F.col("n") > least * SHORT - 1e-9).select("id", "n", F.posexplode(F.slice("members", F.lit(1), head.cast("int"))).alias("at", "member"))
    side = lambda c: prefix.select("member", *(F.col(x).alias(f"{c}_{x}") for x in ("id", "n", "at")))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    still = 1 + F.least("a_at", "b_at") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) - 1
    fits = (F.col("a_id") < F.col("b_id")) & (large > SHORT) & (small >= least * large - 1e-9) & (still >= need)
    return side("a").join(side("b"), "member").where(fits).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def similar_sets(members: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of all sets a < b of rows (id, member) whose Jaccard is at least ``least``, which is over 0.

    Equal sets are compared as one, and its copies come back at the end. Members are taken from the rarest to the most frequent. Short sets meet by as
    many members as they must share, as far as there are few choices of them. Of other sets of n the first n - ceil(least * n) + 1 are the prefix; similar
    sets share a member of both prefixes, their sizes differ by the share at most, and what can still follow the shared member must suffice. What is
    left is counted by the sets themselves. Null ids and members take no part, repeated rows count once. A member is part of one row each set, and sets
    are as long as their own rows; a member that very many sets have is in prefixes only of sets that have nothing rarer.
    """
    own = members.select("id", "member").dropna().distinct()
    often = own.groupBy("member").agg(F.count("*").alias("often"))
    listed = F.array_sort(F.collect_list(F.struct("often", "member")))
    every = own.join(often, "member").groupBy("id").agg(F.transform(listed, lambda x: x["member"]).alias("members"))
    every = written(every, "set-members")
    sets = written(every.groupBy("members").agg(F.min("id").alias("id")).withColumn("n", F.size("members")), "set-classes")
    copies = written(every.join(sets.select("members", F.col("id").alias("set")), "members").select("set", "id"), "set-copies")
    pairs = _short_pairs(members.sparkSession, sets, least).unionByName(_long_pairs(sets, least)).distinct()
    whole = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"{c}_members"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    shared = F.size(F.array_intersect("a_members", "b_members"))
    jaccard = shared / (F.size("a_members") + F.size("b_members") - shared)
    alike = both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)
    alike = alike.unionByName(sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))
    of = lambda c: copies.select(F.col("set").alias(c), F.col("id").alias(f"{c}_id"))
    out = alike.join(of("a"), "a").join(of("b"), "b").where("a <> b or a_id < b_id")
    return out.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "jaccard")
