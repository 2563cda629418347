"""Queries of the semantic dimension: vectors, matching, attributes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import text as tx
from ..functions import vectors as v
from ..operators import assign, axes, pooling, set_join, similar
from .registry import intervals, lanes, query, r4, table

_E = """
with em as (select vec_id, label, embedding::double[] as x from embeddings), ref as (select * from em where vec_id % 2 = 0), gen as (select * from em where vec_id % 2 = 1
), sim as (select r.label, r.vec_id as r, g.vec_id as g, list_cosine_similarity(r.x, g.x) as c from ref r join gen g on r.label = g.label)
"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Even vectors as references, odd ones as generated, with their label as key."""
    em = table(spark, d, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return em.where("id % 2 = 0"), em.where("id % 2 = 1")


@query(_E + ", k as (select *, row_number() over (partition by r order by round(c, 6) desc, g) as k from sim) select r, g, round(c, 4) as cosine, k::int as rank from k where k <= 3")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    best = similar.best_within(*_sides(spark, d), 3)
    return best.select(F.col("left_id").alias("r"), F.col("right_id").alias("g"), r4(F.col("cosine"), "cosine"), "rank")


@query(_E + "select label, count(*) as n, count(*) filter (where round(greatest(0, least(1, (c - 0.5) / 0.5)), 6) >= 0.6) as n_gated, round(avg((c + 1) / 2), 4) as mean01, round(avg(greatest(0, least(1, (c - 0.5) / 0.5))), 4) as mean_calibrated from sim group by label")
def cosine_gate_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Pairs under the threshold add nothing to the calibrated mean, and the plain mean needs no pairs."""
    sides = _sides(spark, d)
    cal = v.calibrated(F.col("cosine"), 0.5)
    high = similar.pairs_above(*sides, 0.5).groupBy("key").agg(F.count_if(F.round(cal, 6) >= 0.6).alias("n_gated"), F.sum(cal).alias("total"))
    out = similar.mean_cosine(*sides).join(high, "key", "left")
    mean = F.coalesce("total", F.lit(0.0)) / F.col("n")
    return out.select(F.col("key").alias("label"), "n", F.coalesce("n_gated", F.lit(0)).alias("n_gated"), r4((F.col("mean") + 1) / 2, "mean01"), r4(mean, "mean_calibrated"))


@query("""
with em as (select vec_id, label, embedding::double[] as x from embeddings), ref as (select * from em where vec_id % 2 = 0), gen as (select * from em where vec_id % 2 = 1
), ch as (
  select r.label, greatest(0, least(1, list_cosine_similarity(r.x[1:32], g.x[1:32]))) as a, greatest(0, least(1, list_cosine_similarity(r.x[33:64], g.x[33:64]))) as b
  from ref r join gen g on r.label = g.label and r.vec_id // 16 = g.vec_id // 16
) select label, count(*) as n, round(max(0.4 * a + 0.6 * b), 4) as weighted, round(avg(greatest(a, b)), 4) as larger from ch group by label""")
def channel_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Name and attribute channels, the halves of a vector, fused by weight and by the larger."""
    em = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat_ws("_", (F.col("label")).cast("string"), F.expr("vec_id div 16").cast("string")).alias("sample"), "label", v.as_double(F.col("embedding")).alias("x"))
    em = em.select("id", "sample", "label", F.slice("x", 1, 32).alias("name_vec"), F.slice("x", 33, 32).alias("set_vec"))
    sims = axes.entity_similarity(em.where("id % 2 = 0"), em.where("id % 2 = 1"), tau=0.0)
    a, b = F.col("name_sim"), F.col("set_sim")
    label = F.substring_index("sample", "_", 1).cast("int")
    return sims.groupBy(label.alias("label")).agg(F.count("*").alias("n"), r4(F.max(v.fused(a, b)), "weighted"), r4(F.avg(v.fused(a, b, max_of=True)), "larger"))


@query("""
with x as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x, 1 + vec_id % 3 as w from embeddings), m as (select label, i, sum(w * x) / sum(w) as m from x group by label, i
), n as (select label, sqrt(sum(m * m)) as len from m group by label) select label, i - 1 as i, round(m / len, 4) as x from m join n using (label)""")
def set_pooling_centroid(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.col("label").alias("key"), (1 + F.col("vec_id") % 3).alias("w"), F.col("embedding").alias("x"))
    m = pooling.pooled(x).where("x is not null")
    return m.select(F.col("key").alias("label"), F.posexplode("x").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), r4(F.col("x"), "x"))


_BEST = _E + ", a as (select *, row_number() over (partition by r order by round(c, 6) desc, g) as kr, row_number() over (partition by g order by round(c, 6) desc, r) as kg from sim), best as (select * from a where kr = 1 and kg = 1)"


def _mutual(spark: SparkSession, d: str) -> DataFrame:
    """(label, r, g, c) of the vectors that are each other's nearest."""
    ref, gen = _sides(spark, d)
    one = similar.best_within(ref, gen).select(F.col("key").alias("label"), F.col("left_id").alias("r"), F.col("right_id").alias("g"), F.col("cosine").alias("c"))
    two = similar.best_within(gen, ref).select(F.col("key").alias("label"), F.col("left_id").alias("g"), F.col("right_id").alias("r"))
    return one.join(two, ["label", "r", "g"])


@query(_BEST + " select label, r, g, round(c, 4) as cosine from best")
def mutual_best_match(spark: SparkSession, d: str) -> DataFrame:
    return _mutual(spark, d).select("label", "r", "g", r4(F.col("c"), "cosine"))


@query(_BEST + " select r.label, count(*) as n, round(100 * avg(coalesce(greatest(b.c, 0), 0)), 4) as catcov from ref r left join best b on r.vec_id = b.r group by r.label")
def catcov(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity of the matched over all reference entities."""
    ref = _sides(spark, d)[0].select(F.col("id").alias("r"), F.col("key").alias("label"))
    return ref.join(_mutual(spark, d).select("r", "c"), "r", "left").groupBy("label").agg(F.count("*").alias("n"), r4(100 * F.avg(F.coalesce(F.greatest("c", F.lit(0.0)), F.lit(0.0))), "catcov"))


@query(_BEST + """, u as (select vec_id as g, label from gen where vec_id not in (select g from best)), p as (select u.label, u.g, 1 - greatest(max(s.c), 0) as pen from u join sim s on s.g = u.g group by u.label, u.g
), n as (select label, count(*) as n from gen group by label) select n.label, round(100 * (1 - least(1, greatest(0, coalesce(sum(p.pen), 0) / n.n))), 4) as par from n left join p on n.label = p.label group by n.label, n.n""")
def parsimony(spark: SparkSession, d: str) -> DataFrame:
    """Penalty of generated entities without a match: 1 less their best similarity to any reference."""
    ref, gen = _sides(spark, d)
    near = similar.best_within(gen, ref, places=15).select(F.col("key").alias("label"), F.col("left_id").alias("g"), (1 - F.greatest("cosine", F.lit(0.0))).alias("pen"))
    pen = near.join(_mutual(spark, d).select("g"), "g", "left_anti").groupBy("label").agg(F.sum("pen").alias("pen"))
    n = gen.groupBy(F.col("key").alias("label")).agg(F.count("*").alias("n"))
    return n.join(pen, "label", "left").select("label", r4(100 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("pen", F.lit(0.0)) / F.col("n")))), "par"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of event matching within a sample, by vectors and intervals; each vector's length is taken once, not for every pair."""
    from .q_events import _rtiou

    em = table(spark, d, "embeddings").select("vec_id", v.as_double(F.col("embedding")).alias("x"))
    em = em.select("vec_id", v.unit(F.col("x")).alias("x"))
    ref, gen = lanes(spark, d)
    side = lambda t, c: t.join(em.select(F.col("vec_id").alias(f"{c}_vec_id"), F.col("x").alias(f"{c}_x")), f"{c}_vec_id", "left")
    p = side(ref, "r").join(side(gen, "g"), "key")
    sim = v.similarity01(v.dot(F.col("r_x"), F.col("g_x")))
    score = 0.8 * sim + 0.2 * _rtiou()
    return p.select("key", F.col("r_id").alias("ref_id"), F.col("g_id").alias("gen_id"), score.alias("score"), (sim >= 0.5).alias("gated"))


@query()
def optimal_match_event(spark: SparkSession, d: str) -> DataFrame:
    return assign.match(_candidates(spark, d), mode="event")


@query()
def optimal_match_semantic(spark: SparkSession, d: str) -> DataFrame:
    return assign.match(_candidates(spark, d), mode="dummy", gate=0.4)


#: Candidates of a key, as the SQL twins see them.
_CAND = """, em as (select vec_id, embedding::double[] as x from embeddings
), p as (
  select r.key, r.id as ref_id, g.id as gen_id, coalesce((list_cosine_similarity(a.x, b.x) + 1) / 2, 0) as sim
  from iv r join iv g on r.key = g.key and r.lane = 0 and g.lane = 1 left join em a on a.vec_id = r.vec_id left join em b on b.vec_id = g.vec_id
)"""


@query(_CAND + " select distinct key, true as one_to_one, true as feasible, 0.0::double as gap from p")
def optimal_event_certificate(spark: SparkSession, d: str) -> DataFrame:
    """That the matching of events is one to one and that no choice of gated pairs is better: its prices cover all of them and cost no more."""
    return assign.certificate(_candidates(spark, d), mode="event").select("key", "one_to_one", "feasible", F.abs(F.round("gap", 4)).alias("gap"))


@query(_CAND + " select distinct key, true as one_to_one, true as feasible, 0.0::double as gap from p")
def optimal_semantic_certificate(spark: SparkSession, d: str) -> DataFrame:
    """The same of the matching whose items may stay alone."""
    return assign.certificate(_candidates(spark, d), mode="dummy", gate=0.4).select("key", "one_to_one", "feasible", F.abs(F.round("gap", 4)).alias("gap"))


@query(""", em as (select vec_id, embedding::double[] as x from embeddings
), p as (
  select r.key, r.id as ref_id, g.id as gen_id, coalesce((list_cosine_similarity(a.x, b.x) + 1) / 2, 0) as sim,
         (greatest(0.0, least(r.e, g.e) - greatest(r.s, g.s)) + 1e-6) / (greatest(r.e, g.e) - least(r.s, g.s) + 1e-6) as iou
  from iv r join iv g on r.key = g.key and r.lane = 0 and g.lane = 1 left join em a on a.vec_id = r.vec_id left join em b on b.vec_id = g.vec_id
), cand as (select key, ref_id, gen_id, 0.8 * sim + 0.2 * iou as score from p where sim >= 0.5 and 0.8 * sim + 0.2 * iou > 0.4
), rec as (
  select key, []::bigint[] as ur, []::bigint[] as ug, null::bigint as ref_id, null::bigint as gen_id, null::double as score from (select distinct key from cand)
  union all
  select r.key, r.ur || [c.ref_id], r.ug || [c.gen_id], c.ref_id, c.gen_id, c.score from rec r, lateral (
    select * from cand where cand.key = r.key and not list_contains(r.ur, cand.ref_id) and not list_contains(r.ug, cand.gen_id) order by cand.score desc, cand.ref_id, cand.gen_id limit 1) c
) select key, ref_id, gen_id, round(score, 4) as score from rec where ref_id is not null""", recursive=True)
def greedy_match_gated(spark: SparkSession, d: str) -> DataFrame:
    out = assign.match(_candidates(spark, d), mode="greedy", gate=0.4)
    return out.select("key", "ref_id", "gen_id", r4(F.col("score"), "score"))


@query()
def unmatched_both_sides(spark: SparkSession, d: str) -> DataFrame:
    found = assign.match(_candidates(spark, d), mode="event")
    iv = intervals(spark, d).select("key", "id", "lane")
    taken = found.select("key", F.explode(F.array("ref_id", "gen_id")).alias("id"))
    return iv.join(taken, ["key", "id"], "left_anti")


_ATTR = "with attrs as (select p_brand as entity, 'type' as k, p_type as v from part union all select p_brand, 'size', p_size::varchar from part)"


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("entity"), F.lit("type").alias("k"), F.col("p_type").alias("v")).union(p.select("p_brand", F.lit("size"), F.col("p_size").cast("string")))


@query(_ATTR + """, s as (select entity, list(distinct k || '=' || v) as s from attrs group by entity)
select a.entity as a, b.entity as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 4) as jaccard from s a join s b on a.entity < b.entity where len(list_intersect(a.s, b.s)) > 0""")
def attr_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of the attribute sets of entities that share a value, by counting those: no set is compared with another in full."""
    at = _attributes(spark, d).select("entity", F.concat_ws("=", "k", "v").alias("x")).distinct()
    n = at.groupBy("entity").agg(F.count("*").alias("n"))
    other = at.select(F.col("entity").alias("b"), "x")
    both = at.withColumnRenamed("entity", "a").join(other, "x").where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    both = both.join(n.select(F.col("entity").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("entity").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", r4(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), "jaccard"))


@query("""with m as (
  select p_partkey as id, unnest(list_distinct(string_split(lower(p_name), ' ') || ['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size::varchar])) as member from part
), n as (select id, count(*) as n from m group by id
), i as (select a.id as a, b.id as b, count(*) as i from m a join m b on a.member = b.member and a.id < b.id group by a.id, b.id)
select a, b, round(i / (x.n + y.n - i), 4) as jaccard from i join n x on x.id = a join n y on y.id = b where i >= 0.7 * (x.n + y.n - i)""")
def similar_attribute_sets(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose words and attributes are 0.7 alike or more, by prefixes of their rarest members."""
    p = table(spark, d, "part")
    named = lambda k, c: F.concat(F.lit(f"{k}="), F.col(c).cast("string"))
    members = F.explode(F.concat(F.split(F.lower("p_name"), " "), F.array(named("brand", "p_brand"), named("type", "p_type"), named("size", "p_size"))))
    return set_join.similar_sets(p.select(F.col("p_partkey").alias("id"), members.alias("member")), 0.7).select("a", "b", r4(F.col("jaccard"), "jaccard"))


@query(_ATTR + " select k, count(distinct v) as n_values, count(distinct entity) as n_entities, count(distinct (entity, v)) as n_pairs, string_agg(distinct v, ',' order by v) as vals from attrs where k = 'type' group by k")
def attr_union_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _attributes(spark, d).where("k = 'type'").groupBy("k").agg(F.count_distinct("v").alias("n_values"), F.count_distinct("entity").alias("n_entities"), F.count_distinct("entity", "v").alias("n_pairs"), F.array_join(F.array_sort(F.collect_set("v")), ",").alias("vals"))


_AIC = """
with a as (select p_brand as entity, k, v, count(*) as n from (select p_brand, 'type' as k, p_type as v, p_partkey from part union all select p_brand, 'mod', (p_size % 7)::varchar, p_partkey from part) group by all
), lane as (select entity, k, v, n, (n % 2) as side from a), r as (select * from lane where side = 0), g as (select * from lane where side = 1
), best as (select r.entity, r.k, r.v, coalesce(max(least(r.n, g.n) / greatest(r.n, g.n)), 0) as s from r left join g on r.entity = g.entity and r.k = g.k group by r.entity, r.k, r.v
), key as (select entity, k, avg(s) as s, case when k = 'type' then 1.5 else 1.0 end as w from best group by entity, k)
"""


@query(_AIC + "select entity, round(sum(w * s), 4) as covered, round(sum(w), 4) as weight, round(100 * sum(w * s) / sum(w), 4) as aic from key group by entity")
def aic_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each reference value takes its most similar generated one of the same key; keys are weighted and pooled."""
    p = table(spark, d, "part")
    a = p.select("p_brand", F.lit("type").alias("k"), F.col("p_type").alias("v")).union(p.select("p_brand", F.lit("mod"), (F.col("p_size") % 7).cast("string")))
    a = a.groupBy(F.col("p_brand").alias("entity"), "k", "v").agg(F.count("*").alias("n"))
    r, g = a.where("n % 2 = 0"), a.where("n % 2 = 1").select("entity", "k", F.col("n").alias("m"))
    best = r.join(g, ["entity", "k"], "left").groupBy("entity", "k", "v").agg(F.coalesce(F.max(F.least("n", "m") / F.greatest("n", "m")), F.lit(0.0)).alias("s"))
    key = best.groupBy("entity", "k").agg(F.avg("s").alias("s")).withColumn("w", F.when(F.col("k") == "type", 1.5).otherwise(1.0))
    return key.groupBy("entity").agg(r4(F.sum(F.col("w") * F.col("s")), "covered"), r4(F.sum("w"), "weight"), r4(100 * F.sum(F.col("w") * F.col("s")) / F.sum("w"), "aic"))


@query(r"""
select p_partkey, regexp_replace(regexp_replace(lower(nfc_normalize(p_name || ' cafe' || chr(769) || '_ ' || p_type || '!')), '[.,;:!?\s]+$', ''), '\s*_\s*', '-', 'g') as norm from part""")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" cafe\u0301_ "), "p_type", F.lit("!"))
    return table(spark, d, "part").select("p_partkey", tx.normalise(ev.nfc(raw)).alias("norm"))


@query(r"""
with c as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[|。:;.]'), lambda p: trim(p, ' ')), lambda p: p <> '')[1:8] as c from documents)
select doc_id, len(c) as n, coalesce(c[1], '') as head, coalesce(array_to_string(list_transform(c, lambda p: length(p)), ','), '') as lens from c""")
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", tx.clauses(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.coalesce(F.get("c", F.lit(0)), F.lit("")).alias("head"), F.array_join(F.transform("c", lambda p: F.length(p).cast("string")), ",").alias("lens"))


@query(r"""
with t as (select doc_id, unnest(list_distinct(string_split(translate(text, chr(10), ' '), ' '))) as raw from documents), n as (select doc_id, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') as v from t
), k as (select distinct doc_id, v from n where v <> '' and length(regexp_replace(v, '[^a-z]', '', 'g')) > 0 and not (length(regexp_replace(v, '[^a-z]', '', 'g')) <= 1 and length(v) <= 2)) select doc_id, count(*) as n from k group by doc_id""")
def value_filter_gates(spark: SparkSession, d: str) -> DataFrame:
    # A text is normalised once as a whole, which leaves its blanks, and only the different words of it are judged.
    flat = F.regexp_replace(F.lower(F.translate("text", "\n", " ")), "[^a-z0-9 ]+", "")
    n = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(flat, " "))).alias("v")).where(tx.keeps_value(F.lit("open"), F.col("v")))
    return n.distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select doc_id, case when length(text) > 80 then substring(text, 1, 77) || '...' else text end as caption, length(text) as n from documents")
def caption_truncate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 77), F.lit("..."))).otherwise(t).alias("caption"), F.length(t).cast("long").alias("n"))


@query("select lang, source, count(*) as n, count(distinct text) as n_texts from documents group by lang, source")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))
