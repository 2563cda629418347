"""The semantic axes end to end: two channels, matching, binding, parsimony and the fused score, on the driver's vectors.

Stand-in: 16 vectors in a row are a sample, even ids its reference entities, odd ones the generated; the first half of a vector is the name's, the
second the attribute set's. Each entity has two attributes whose values are named by the ids of 40 vectors, which are the values' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import assign, axes
from .registry import query, r4, table

WEIGHTS, GATE = {"k0": 1.5, "k2": 0.5}, 0.02

_BASE = """
with em as (select vec_id as id, vec_id // 16 as sample, vec_id % 2 as side, embedding::double[] as x from embeddings
), r as (select * from em where side = 0), g as (select * from em where side = 1
), chan as (
  select r.sample, r.id as ref_id, g.id as gen_id, greatest(0, least(1, list_cosine_similarity(r.x[1:32], g.x[1:32]))) as name_sim,
         greatest(0, least(1, list_cosine_similarity(r.x[33:64], g.x[33:64]))) as set_sim from r join g on r.sample = g.sample
), sims as (select *, 0.4 * name_sim + 0.6 * set_sim as sim from chan
), ranked as (
  select *, row_number() over (partition by sample, ref_id order by round(sim, 6) desc, gen_id) as kr,
         row_number() over (partition by sample, gen_id order by round(sim, 6) desc, ref_id) as kg from sims
), matched as (select * from ranked where kr = 1 and kg = 1 and round(sim, 6) > 0.02
), attrs as (
  select distinct id, sample, side, 'k' || ((id // 2 + j) % 3) as key, (id * (7 + 4 * j) + j) % 40 as value from em cross join (values (0), (1)) t(j)
), vsim as (
  select a.id as rv, b.id as gv, greatest(0, least(1, list_cosine_similarity(a.x, b.x))) as s from em a cross join em b where a.id < 40 and b.id < 40
), ra as (select * from attrs where side = 0), ga as (select * from attrs where side = 1
), vs as (
  select ra.sample, ra.key, ra.id as ref_id, ra.value as ref_value, ga.id as gen_id, ga.value as gen_value, s
  from ra join ga on ra.sample = ga.sample and ra.key = ga.key join vsim on rv = ra.value and gv = ga.value
), wt as (select 'k' || k as key, case k when 0 then 1.5 when 2 then 0.5 else 1.0 end as w from range(3) t(k)
), star as (select sample, gen_id, key, gen_value, max(s) as star from vs group by all
), hit as (
  select m.sample, m.ref_id, m.gen_id, ra.key, ra.value, coalesce(max(vs.s), 0) as s from matched m join ra on ra.sample = m.sample and ra.id = m.ref_id
  left join vs on vs.ref_id = m.ref_id and vs.gen_id = m.gen_id and vs.key = ra.key and vs.ref_value = ra.value group by all
), bykey as (select sample, ref_id, gen_id, key, avg(s) as hit from hit group by all
), cov as (select b.sample, ref_id, gen_id, sum(w * hit) as cn, greatest(sum(w), 1e-8) as cd from bykey b join wt using (key) group by all
), near as (select ref_id, gen_id, key, gen_value, max(s) as near from vs group by all
), mis as (
  select m.sample, m.ref_id, m.gen_id, sum(w * greatest(0, star - coalesce(near, 0))) as mn, sum(w * star) as md
  from matched m join star t on t.sample = m.sample and t.gen_id = m.gen_id join wt using (key)
  left join near n on n.ref_id = m.ref_id and n.gen_id = m.gen_id and n.key = t.key and n.gen_value = t.gen_value group by all
), pooled as (
  select m.sample, sum(coalesce(cn, 0)) as cn, sum(coalesce(cd, 0)) as cd, sum(coalesce(mn, 0)) as mn, sum(greatest(coalesce(md, 0), 1e-8)) as md
  from matched m left join cov on cov.ref_id = m.ref_id and cov.gen_id = m.gen_id left join mis on mis.ref_id = m.ref_id and mis.gen_id = m.gen_id group by m.sample
), aic as (
  select sample, case when cd > 0 then cn / (cd + 1e-8) else 0 end as coverage, greatest(0, least(1, mn / (md + 1e-8))) as misbind from pooled
), extra as (
  select g.sample, sum(1 - coalesce(best, 0)) as ec from g left join (select gen_id, max(sim) as best from sims group by gen_id) b on b.gen_id = g.id
  where g.id not in (select gen_id from matched) group by g.sample
), exattr as (
  select ga.sample, sum(w * (1 - coalesce(star, 0))) as ea, sum(w) as aw from ga join matched m on m.gen_id = ga.id join wt using (key)
  left join star t on t.gen_id = ga.id and t.key = ga.key and t.gen_value = ga.value group by ga.sample
), par as (
  select n.sample, n.n_gen, coalesce(ec, 0) as ec, coalesce(ea, 0) as ea, coalesce(aw, 0) as aw,
         100 * (1 - greatest(0, least(1, (coalesce(ec, 0) + coalesce(ea, 0)) / (n_gen + greatest(coalesce(aw, 0), 1e-8) + 1e-8)))) as par
  from (select sample, count(*) as n_gen from g group by sample) n left join extra using (sample) left join exattr using (sample)
), cat as (
  select r.sample, count(*) as n_ref, 100 * avg(coalesce(m.sim, 0)) as catcov from r left join matched m on m.ref_id = r.id group by r.sample
)
"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    em = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 16").alias("sample"), v.as_double(F.col("embedding")).alias("vec"))
    return em.select("*", F.slice("vec", 1, 32).alias("name_vec"), F.slice("vec", 33, 32).alias("set_vec"))


def _sides(table_: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table_.where("id % 2 = 0"), table_.where("id % 2 = 1")


def _attributes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    em = _entities(spark, d)
    two = em.select("id", "sample", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    attrs = two.select("id", "sample", F.concat(F.lit("k"), F.expr("(id div 2 + j) % 3").cast("string")).alias("key"), F.expr("(id * (7 + 4 * j) + j) % 40").alias("value")).distinct()
    return *_sides(attrs), em.where("id < 40").select(F.col("id").alias("value"), "vec")


def _sims(spark: SparkSession, d: str) -> DataFrame:
    return axes.entity_similarity(*_sides(_entities(spark, d)), tau=0.0)


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs, gens = _sides(_entities(spark, d))
    sims = _sims(spark, d)
    ref_attrs, gen_attrs, vectors = _attributes(spark, d)
    matches = axes.mutual_best(sims, gate=GATE)
    values = axes.value_similarity(ref_attrs, gen_attrs, vectors, tau=0.0)
    bound = axes.binding(matches, ref_attrs, gen_attrs, values, WEIGHTS)
    return axes.cat_coverage(refs, matches), bound, axes.parsimony(gens, sims, matches, gen_attrs, values, WEIGHTS)


@query(_BASE + "select sample, ref_id, gen_id, round(name_sim, 4) as name_sim, round(set_sim, 4) as set_sim, round(sim, 4) as sim from sims")
def entity_channels(spark: SparkSession, d: str) -> DataFrame:
    return _sims(spark, d).select("sample", "ref_id", "gen_id", r4(F.col("name_sim"), "name_sim"), r4(F.col("set_sim"), "set_sim"), r4(F.col("sim"), "sim"))


@query(_BASE + "select sample, key, ref_id, ref_value, gen_id, gen_value, round(s, 4) as s from vs")
def value_pairs_by_key(spark: SparkSession, d: str) -> DataFrame:
    out = axes.value_similarity(*_attributes(spark, d), tau=0.0)
    return out.select("sample", "key", "ref_id", "ref_value", "gen_id", "gen_value", r4(F.col("s"), "s"))


@query(_BASE + "select sample, round(coverage, 4) as coverage, round(misbind, 4) as misbind, round(100 * coverage * (1 - misbind), 4) as aic from aic")
def aic_misbind(spark: SparkSession, d: str) -> DataFrame:
    _, aic, _ = _parts(spark, d)
    return aic.select("sample", *(r4(F.col(c), c) for c in ("coverage", "misbind", "aic")))


@query(_BASE + "select sample, n_gen, round(ec, 4) as extra_category, round(ea, 4) as extra_attribute, round(aw, 4) as attribute_weight, round(par, 4) as par from par")
def parsimony_attributes(spark: SparkSession, d: str) -> DataFrame:
    _, _, par = _parts(spark, d)
    return par.select("sample", "n_gen", *(r4(F.col(c), c) for c in ("extra_category", "extra_attribute", "attribute_weight", "par")))


@query(_BASE + """select sample, round(catcov, 4) as catcov, round(coalesce(100 * coverage * (1 - misbind), 0), 4) as aic, round(par, 4) as par,
 round(0.3 * catcov + 0.4 * coalesce(100 * coverage * (1 - misbind), 0) + 0.3 * par, 4) as s_base from cat left join aic using (sample) left join par using (sample)
 where par is not null""")
def s_base(spark: SparkSession, d: str) -> DataFrame:
    """Fused semantic score on mutually best matches; samples without generated entities are left out."""
    out = axes.s_base(*_parts(spark, d)).join(_sides(_entities(spark, d))[1].select("sample").distinct(), "sample", "left_semi")
    return out.select("sample", *(r4(F.col(c), c) for c in ("catcov", "aic", "par", "s_base")))


@query()
def s_base_optimal(spark: SparkSession, d: str) -> DataFrame:
    """The same with the dummy-gated optimal assignment, of which SQL knows nothing."""
    refs, gens = _sides(_entities(spark, d))
    sims = _sims(spark, d)
    ref_attrs, gen_attrs, vectors = _attributes(spark, d)
    asked = sims.select(F.col("sample").alias("key"), "ref_id", "gen_id", F.col("sim").alias("score"), F.lit(True).alias("gated"))
    matches = assign.match(asked, mode="dummy", gate=GATE).select(F.col("key").alias("sample"), "ref_id", "gen_id", F.col("score").alias("sim"))
    values = axes.value_similarity(ref_attrs, gen_attrs, vectors, tau=0.0)
    parts = axes.cat_coverage(refs, matches), axes.binding(matches, ref_attrs, gen_attrs, values, WEIGHTS), axes.parsimony(gens, sims, matches, gen_attrs, values, WEIGHTS)
    return axes.s_base(*parts).select("sample", *(r4(F.col(c), c) for c in ("catcov", "aic", "par", "s_base")))


@query("""
with rep as (
  select vec_id, label, case when vec_id % 5 = 0 then null when vec_id % 7 = 0 then 'nan'::double else list_sum(embedding::double[]) end as s_base,
         case when vec_id % 11 = 0 then 'nan'::double else 1.0 end as par from embeddings
) select label, count(*) as n_valid from rep where s_base is not null and not isnan(s_base) and par is not null and not isnan(par) group by label""")
def reusable_reports(spark: SparkSession, d: str) -> DataFrame:
    e, nan = table(spark, d, "embeddings"), F.lit(float("nan"))
    total = F.aggregate(v.as_double(F.col("embedding")), F.lit(0.0), lambda t, x: t + x)
    rep = e.select("label", F.when(F.col("vec_id") % 5 == 0, None).when(F.col("vec_id") % 7 == 0, nan).otherwise(total).alias("s_base"), F.when(F.col("vec_id") % 11 == 0, nan).otherwise(1.0).alias("par"))
    return axes.valid_reports(rep, ["s_base", "par"]).groupBy("label").agg(F.count("*").alias("n_valid"))
