"""The semantic axes over tables: two-channel similarity, coverage, attribute binding, parsimony and their fused score.

Entities are rows of a sample's reference or generated side; attributes are rows (sample, id, key, value). All steps are equi-joins on
the sample (and key), so that the pairs of one clip meet and no others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v

#: Fixed value: what every division adds to its divisor, and the least divisor of a pair.
EPS = 1e-8
PAIR = ["sample", "ref_id", "gen_id"]


def entity_similarity(refs: DataFrame, gens: DataFrame, *, tau: float = 0.5, name_weight: float = 0.4, max_of: bool = False) -> DataFrame:
    """(sample, ref_id, gen_id, name_sim, set_sim, sim) of all pairs of a sample; sides have (sample, id, name_vec, set_vec)."""
    side = lambda t, c: t.select("sample", F.col("id").alias(f"{c}_id"), F.col("name_vec").alias(f"_{c}n"), F.col("set_vec").alias(f"_{c}s"))
    both = side(refs, "ref").join(side(gens, "gen"), "sample")
    channel = lambda c: F.coalesce(v.calibrated(v.cosine(F.col(f"_ref{c}"), F.col(f"_gen{c}")), tau), F.lit(0.0))
    both = both.select(*PAIR, channel("n").alias("name_sim"), channel("s").alias("set_sim"))
    return both.withColumn("sim", v.fused(F.col("name_sim"), F.col("set_sim"), name_weight=name_weight, max_of=max_of))


def mutual_best(sims: DataFrame, *, gate: float) -> DataFrame:
    """Pairs that are each other's best above ``gate``; values are compared at 6 places, ties go to the smaller id."""
    s = F.round("sim", 6)
    rank = lambda one, other: F.row_number().over(Window.partitionBy("sample", one).orderBy(s.desc(), other))
    ranked = sims.withColumns({"_r": rank("ref_id", "gen_id"), "_g": rank("gen_id", "ref_id")})
    return ranked.where((F.col("_r") == 1) & (F.col("_g") == 1) & (s > gate)).select(*PAIR, "sim")


def value_similarity(ref_attrs: DataFrame, gen_attrs: DataFrame, vectors: DataFrame, *, tau: float = 0.5) -> DataFrame:
    """(sample, key, ref_id, ref_value, gen_id, gen_value, s) of the values that meet under one key of a sample.

    Each pair of different values is compared once over the whole table, whatever the number of entities that have it.
    """
    left = ref_attrs.select("sample", "key", F.col("id").alias("ref_id"), F.col("value").alias("ref_value")).distinct()
    right = gen_attrs.select("sample", "key", F.col("id").alias("gen_id"), F.col("value").alias("gen_value")).distinct()
    met = left.join(right, ["sample", "key"])
    vec = lambda c: vectors.select(F.col("value").alias(f"{c}_value"), F.col("vec").alias(f"_{c}"))
    pairs = met.select("ref_value", "gen_value").distinct().join(vec("ref"), "ref_value").join(vec("gen"), "gen_value")
    pairs = pairs.select("ref_value", "gen_value", F.coalesce(v.calibrated(v.cosine(F.col("_ref"), F.col("_gen")), tau), F.lit(0.0)).alias("s"))
    return met.join(pairs, ["ref_value", "gen_value"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def weight_of(key: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for k in sorted(weights):
        out = F.when(key == k, F.lit(float(weights[k]))).otherwise(out)
    return out


def cat_coverage(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """(sample, n_ref, catcov): mean similarity of the matched over all reference entities, in percent."""
    own = refs.select("sample", F.col("id").alias("ref_id")).join(matches.select("sample", "ref_id", "sim"), ["sample", "ref_id"], "left")
    return own.groupBy("sample").agg(F.count("*").alias("n_ref"), (100 * F.avg(F.coalesce("sim", F.lit(0.0)))).alias("catcov"))


def _star(sims: DataFrame) -> DataFrame:
    """Each generated value's best similarity to any reference value of its key."""
    return sims.groupBy("sample", "gen_id", "key", "gen_value").agg(F.max("s").alias("star"))


def binding(matches: DataFrame, ref_attrs: DataFrame, gen_attrs: DataFrame, sims: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(sample, coverage, misbind, aic) pooled over the matched pairs.

    Coverage: each reference value's best generated one of the pair, averaged by key, weighted. Misbinding: by how much a generated
    value is nearer to some other reference entity than to its own; values whose key no reference entity has take no part.
    A reference entity without attributes adds nothing; samples without matches have no row.
    """
    pair = matches.select(*PAIR)
    w = weight_of(F.col("key"), weights)
    own = ref_attrs.select("sample", F.col("id").alias("ref_id"), "key", F.col("value").alias("ref_value")).distinct()
    hit = pair.join(own, ["sample", "ref_id"]).join(sims.groupBy("sample", "key", "ref_id", "ref_value", "gen_id").agg(F.max("s").alias("s")), [*PAIR, "key", "ref_value"], "left")
    by_key = hit.groupBy(*PAIR, "key").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("hit"))
    cov = by_key.groupBy(*PAIR).agg(F.sum(w * F.col("hit")).alias("cn"), F.greatest(F.sum(w), F.lit(EPS)).alias("cd"))
    shown = gen_attrs.select("sample", F.col("id").alias("gen_id"), "key", F.col("value").alias("gen_value")).distinct()
    near = sims.groupBy(*PAIR, "key", "gen_value").agg(F.max("s").alias("near"))
    bound = pair.join(shown, ["sample", "gen_id"]).join(_star(sims), ["sample", "gen_id", "key", "gen_value"]).join(near, [*PAIR, "key", "gen_value"], "left")
    off = F.greatest(F.lit(0.0), F.col("star") - F.coalesce("near", F.lit(0.0)))
    mis = bound.groupBy(*PAIR).agg(F.sum(w * off).alias("mn"), F.sum(w * F.col("star")).alias("md"))
    all_ = pair.join(cov, PAIR, "left").join(mis, PAIR, "left").fillna(0.0, ["cn", "cd", "mn", "md"]).withColumn("md", F.greatest("md", F.lit(EPS)))
    total = all_.groupBy("sample").agg(*(F.sum(c).alias(c) for c in ("cn", "cd", "mn", "md")))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    coverage = F.when(F.col("cd") > 0, F.col("cn") / (F.col("cd") + EPS)).otherwise(0.0)
    total = total.select("sample", coverage.alias("coverage"), clip(F.col("mn") / (F.col("md") + EPS)).alias("misbind"))
    return total.withColumn("aic", 100 * F.col("coverage") * (1 - F.col("misbind")))


def parsimony(gens: DataFrame, sims: DataFrame, matches: DataFrame, gen_attrs: DataFrame, values: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(sample, n_gen, extra_category, extra_attribute, attribute_weight, par).

    An unmatched generated entity costs 1 less its best similarity; each value of a matched one costs its weight times 1 less its
    best similarity to any reference value of its key, all of it where no reference entity has the key.
    """
    taken = matches.select("sample", "gen_id")
    best = sims.groupBy("sample", "gen_id").agg(F.max("sim").alias("best"))
    entity = gens.select("sample", F.col("id").alias("gen_id"))
    extra = entity.join(taken, ["sample", "gen_id"], "left_anti").join(best, ["sample", "gen_id"], "left")
    extra = extra.groupBy("sample").agg(F.sum(1 - F.coalesce("best", F.lit(0.0))).alias("extra_category"))
    w = weight_of(F.col("key"), weights)
    shown = gen_attrs.select("sample", F.col("id").alias("gen_id"), "key", F.col("value").alias("gen_value")).distinct().join(taken, ["sample", "gen_id"], "left_semi")
    shown = shown.join(_star(values), ["sample", "gen_id", "key", "gen_value"], "left")
    attr = shown.groupBy("sample").agg(F.sum(w * (1 - F.coalesce("star", F.lit(0.0)))).alias("extra_attribute"), F.sum(w).alias("attribute_weight"))
    n = entity.groupBy("sample").agg(F.count("*").alias("n_gen"))
    out = n.join(extra, "sample", "left").join(attr, "sample", "left").fillna(0.0, ["extra_category", "extra_attribute", "attribute_weight"])
    rate = (F.col("extra_category") + F.col("extra_attribute")) / (F.col("n_gen") + F.greatest("attribute_weight", F.lit(EPS)) + EPS)
    return out.withColumn("par", 100 * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))))


def s_base(catcov: DataFrame, aic: DataFrame, par: DataFrame, *, alpha: float = 0.3, beta: float = 0.4, gamma: float = 0.3) -> DataFrame:
    """(sample, catcov, aic, par, s_base); a sample without a row on an axis counts 0 there."""
    out = catcov.select("sample", "catcov").join(aic.select("sample", "aic"), "sample", "full").join(par.select("sample", "par"), "sample", "full").fillna(0.0)
    return out.withColumn("s_base", alpha * F.col("catcov") + beta * F.col("aic") + gamma * F.col("par"))


def valid_reports(reports: DataFrame, scores: list[str]) -> DataFrame:
    """Reports all of whose ``scores`` are numbers: not null and not NaN. Such a report is used again; the others are scored anew."""
    ok = F.lit(True)
    for c in scores:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return reports.where(ok)
