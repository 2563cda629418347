"""Queries of the event dimension: intervals, relations, windows and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import event_total as sc
from ..functions import intervals as iv
from ..operators import assign
from ..operators import events as ev
from ..operators import intervals as op
from .registry import intervals, lane_pairs, lanes, query, r4, table

PAIRS = """, pairs as (
  select r.key, r.id as rid, g.id as gid, r.s as rs, r.e as re, g.s as gs, g.e as ge, r.vec_id as rv, g.vec_id as gv
  from iv r join iv g on r.key = g.key and r.lane = 0 and g.lane = 1
), meas as (
  select *, greatest(0.0, least(re, ge) - greatest(rs, gs)) as inter, greatest(re, ge) - least(rs, gs) as hull from pairs
)"""


def _rtiou():
    return iv.hull_iou(F.col("r_s"), F.col("r_e"), F.col("g_s"), F.col("g_e"))


@query(PAIRS + " select key, rid as ref_id, gid as gen_id, round((inter + 1e-6) / (hull + 1e-6), 4) as rtiou from meas")
def rtiou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lane_pairs(spark, d).select("key", F.col("r_id").alias("ref_id"), F.col("g_id").alias("gen_id"), r4(_rtiou(), "rtiou"))


@query(PAIRS + " select key, count(*) as n_pairs, count(*) filter (where (inter + 1e-6) / (hull + 1e-6) >= 0.2) as n_gated from meas group by key")
def rtiou_gate(spark: SparkSession, d: str) -> DataFrame:
    return lane_pairs(spark, d).groupBy("key").agg(F.count("*").alias("n_pairs"), F.count_if(_rtiou() >= 0.2).alias("n_gated"))


ALLEN = """case when abs({a}s - {b}s) <= 1e-3 and abs({a}e - {b}e) <= 1e-3 then 'E' when abs({a}s - {b}s) <= 1e-3 and {a}e < {b}e - 1e-3 then 'S' when abs({a}s - {b}s) <= 1e-3 and {b}e < {a}e - 1e-3 then 'Si'
 when abs({a}e - {b}e) <= 1e-3 and {b}s < {a}s - 1e-3 then 'F' when abs({a}e - {b}e) <= 1e-3 and {a}s < {b}s - 1e-3 then 'Fi' when {b}s < {a}s - 1e-3 and {a}e < {b}e - 1e-3 then 'D' when {a}s < {b}s - 1e-3 and {b}e < {a}e - 1e-3 then 'Di'
 when abs({a}e - {b}s) <= 1e-3 then 'M' when abs({b}e - {a}s) <= 1e-3 then 'Mi' when {a}e < {b}s - 1e-3 then 'B' when {b}e < {a}s - 1e-3 then 'Bi'
 when {a}s < {b}s - 1e-3 and {b}s < {a}e - 1e-3 and {a}e < {b}e - 1e-3 then 'O' when {b}s < {a}s - 1e-3 and {a}s < {b}e - 1e-3 and {b}e < {a}e - 1e-3 then 'Oi'
 when {a}s + {a}e <= {b}s + {b}e then 'O' else 'Oi' end"""


@query(PAIRS + f" select {ALLEN.format(a='r', b='g')} as relation, count(*) as n from meas group by 1")
def allen_relation_matrix(spark: SparkSession, d: str) -> DataFrame:
    rel = iv.allen(F.col("r_s"), F.col("r_e"), F.col("g_s"), F.col("g_e"))
    return lane_pairs(spark, d).groupBy(rel.alias("relation")).agg(F.count("*").alias("n"))


def _zipped(spark: SparkSession, d: str) -> DataFrame:
    """Matches for the score queries: the n-th reference event of a sample with the n-th generated one, by start."""
    ref, gen = lanes(spark, d)
    ref = ref.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("r_s", "r_id")))
    gen = gen.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("g_s", "g_id")))
    return ref.join(gen, ["key", "rn"])


ZIP = """, ranked as (select *, row_number() over (partition by key, lane order by s, id) as rn from iv
), matched as (
  select r.key, r.rn, r.id as rid, g.id as gid, r.s as rs, r.e as re, g.s as gs, g.e as ge, r.value as rval, g.value as gval from ranked r join ranked g on r.key = g.key and r.rn = g.rn and r.lane = 0 and g.lane = 1
)"""
_AFF = "(values " + ", ".join(f"('{a}', '{b}', {v}), ('{b}', '{a}', {v})" for (a, b), v in iv.AFFINITY.items()) + ") as aff(a, b, v)"


@query(f"""{ZIP}, two as (
  select x.key, {ALLEN.format(a="x.r", b="y.r")} as rr, {ALLEN.format(a="x.g", b="y.g")} as gr from matched x join matched y on x.key = y.key and x.rn < y.rn
) select t.key, count(*) as n_relations, count(*) filter (where rr = gr) as n_equal, round(avg(case when rr = gr then 1.0 else coalesce(aff.v, 0.0) end) * 100, 4) as erel
from two t left join {_AFF} on t.rr = aff.a and t.gr = aff.b group by t.key""")
def allen_affinity_score(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("key", "n_relations", "n_equal", r4(F.col("erel"), "erel"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    """Relation score of every key with two or more matches, not rounded."""
    m = _zipped(spark, d)
    other = m.select("key", *(F.col(c).alias(f"{c}2") for c in ("rn", "r_s", "r_e", "g_s", "g_e")))
    two = m.join(other, "key").where("rn < rn2")
    rr, gr = (iv.allen(F.col(f"{c}_s"), F.col(f"{c}_e"), F.col(f"{c}_s2"), F.col(f"{c}_e2")) for c in "rg")
    two = two.withColumns({"rr": rr, "gr": gr})
    return two.groupBy("key").agg(F.count("*").alias("n_relations"), F.count_if(F.col("rr") == F.col("gr")).alias("n_equal"), (F.avg(iv.affinity(F.col("rr"), F.col("gr"))) * 100).alias("erel"))


@query(f"{ZIP} select key, count(*) as n, round(100 * sum(sqrt(re - rs) * (rval / (rval + gval))) / sum(sqrt(re - rs)), 4) as ega from matched where re > rs group by key")
def ega_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    w, q = F.sqrt(F.col("r_e") - F.col("r_s")), F.col("r_value") / (F.col("r_value") + F.col("g_value"))
    return _zipped(spark, d).where("r_e > r_s").groupBy("key").agg(F.count("*").alias("n"), r4(100 * F.sum(w * q) / F.sum(w), "ega"))


_ECR = f"""{ZIP}, n as (select key, count(*) filter (where lane = 0) as n_ref, count(*) filter (where lane = 1) as n_gen from iv group by key
), k as (select key, count(*) as m from matched group by key
), c as (select n.*, coalesce(m, 0) as m from n left join k using (key)
), p as (select *, case when n_ref > 0 then m / n_ref else 0 end as cov, case when n_gen > 0 then m / n_gen else 0 end as prec from c)
"""


def _ecr(spark: SparkSession, d: str) -> DataFrame:
    n = intervals(spark, d).groupBy("key").agg(F.count_if(F.col("lane") == 0).alias("n_ref"), F.count_if(F.col("lane") == 1).alias("n_gen"))
    c = n.join(_zipped(spark, d).groupBy("key").agg(F.count("*").alias("m")), "key", "left").fillna(0, ["m"])
    c = c.withColumns({"cov": F.coalesce(F.try_divide("m", "n_ref"), F.lit(0.0)), "prec": F.coalesce(F.try_divide("m", "n_gen"), F.lit(0.0))})
    return c.withColumn("f1", F.when(F.col("cov") + F.col("prec") > 0, 200 * F.col("cov") * F.col("prec") / (F.col("cov") + F.col("prec"))).otherwise(0.0))


@query(_ECR + "select key, round(cov, 4) as coverage, round(prec, 4) as prec, round(case when cov + prec > 0 then 200 * cov * prec / (cov + prec) else 0 end, 4) as ecr from p")
def ecr_f1(spark: SparkSession, d: str) -> DataFrame:
    return _ecr(spark, d).select("key", r4(F.col("cov"), "coverage"), r4(F.col("prec"), "prec"), r4(F.col("f1"), "ecr"))


def _ega_ecr(spark: SparkSession, d: str) -> DataFrame:
    w, q = F.sqrt(F.col("r_e") - F.col("r_s")), F.col("r_value") / (F.col("r_value") + F.col("g_value"))
    ega = _zipped(spark, d).where("r_e > r_s").groupBy("key").agg((100 * F.sum(w * q) / F.sum(w)).alias("ega"), F.count("*").alias("n"))
    return _ecr(spark, d).join(ega, "key", "left")


_TOTAL = f""", g as (select key, 100 * sum(sqrt(re - rs) * (rval / (rval + gval))) / sum(sqrt(re - rs)) as ega from matched where re > rs group by key
), two as (
  select x.key, {ALLEN.format(a="x.r", b="y.r")} as rr, {ALLEN.format(a="x.g", b="y.g")} as gr from matched x join matched y on x.key = y.key and x.rn < y.rn
), rel as (
  select t.key, avg(case when rr = gr then 1.0 else coalesce(aff.v, 0.0) end) * 100 as erel from two t left join {_AFF} on t.rr = aff.a and t.gr = aff.b group by t.key
), f as (select *, case when cov + prec > 0 then 200 * cov * prec / (cov + prec) else 0 end as f1 from p)
"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _ega_ecr(spark, d).join(_relations(spark, d).select("key", "erel"), "key", "left")


@query(_ECR + _TOTAL + """select f.key, erel is not null as erel_valid,
 round(case when erel is not null then 0.2 * coalesce(ega, 0) + 0.2 * erel + 0.6 * f1 else 0.2 * coalesce(ega, 0) + 0.8 * f1 end, 4) as s_event,
 round(case when erel is not null then 0.2 * coalesce(ega, 0) + 0.2 * erel + 0.6 * f1 else 0.5 * coalesce(ega, 0) + 0.5 * f1 end, 4) as s_equal,
 round(case when erel is not null then 0.2 * coalesce(ega, 0) + 0.2 * erel + 0.6 * f1 else 0.25 * coalesce(ega, 0) + 0.75 * f1 end, 4) as s_proportional
from f left join g using (key) left join rel using (key)""")
def s_event_reweighted(spark: SparkSession, d: str) -> DataFrame:
    """The event total under the three ways to do without a relation score: fixed weights, equal ones, those of the others in proportion."""
    parts = _parts(spark, d)
    total = lambda way: sc.event_total(F.col("ega"), F.col("erel"), F.col("f1"), without=way)
    return parts.select("key", F.col("erel").isNotNull().alias("erel_valid"), r4(total((0.2, 0.8)), "s_event"), r4(total("equal"), "s_equal"), r4(total("proportional"), "s_proportional"))


@query(_ECR + _TOTAL + """select f.key, erel is not null as erel_valid, round(erel, 4) as erel,
 round(case when erel is not null then 0.2 * coalesce(ega, 0) + 0.2 * erel + 0.6 * f1 else 0.2 * coalesce(ega, 0) + 0.8 * f1 end, 4) as s_event
from f left join g using (key) left join rel using (key)""")
def s_event_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Weights .2/.2/.6 with the relation score of the key's matches, valid from two matches on; .2/.8 without it."""
    total = sc.event_total(F.col("ega"), F.col("erel"), F.col("f1"), without=(0.2, 0.8))
    return _parts(spark, d).select("key", F.col("erel").isNotNull().alias("erel_valid"), r4(F.col("erel"), "erel"), r4(total, "s_event"))


@query()
def s_event_optimal(spark: SparkSession, d: str) -> DataFrame:
    """The event total on the optimal assignment of vectors and times, by the library's own steps from candidates to score."""
    from . import q_semantic

    ref, gen = lanes(spark, d)
    matches = assign.match(q_semantic._candidates(spark, d), mode="event").withColumnRenamed("score", "q")
    side = lambda t, c: t.select("key", F.col(f"{c}_id").alias("id"), F.col(f"{c}_s").alias("s"), F.col(f"{c}_e").alias("e"))
    out = ev.event_scores(matches, side(ref, "r"), side(gen, "g"))
    return out.select("key", *(r4(F.col(c), c) for c in ("ega", "erel", "ecr", "s_event")))


@query(", d as (select a.key, a.id, b.id as id_r, least(a.e, b.e) - greatest(a.s, b.s) as overlap from iv a join iv b on a.key = b.key and a.lane = 0 and b.lane = 1 and a.s < b.e and b.s < a.e) select key, id, id_r, round(overlap, 4) as overlap from d")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    x = intervals(spark, d).select("key", "id", "lane", "s", "e")
    out = op.overlap_join(x.where("lane = 0"), x.where("lane = 1"), ["key"], width=43200.0)
    return out.select("key", "id", "id_r", r4(F.least("e", "e_r") - F.greatest("s", "s_r"), "overlap"))


@query(PAIRS + """, t as (select key, sum(e - s) filter (where lane = 0) as tr, sum(e - s) filter (where lane = 1) as tg from iv group by key)
select m.key, round(sum(inter) / greatest(1e-6, least(any_value(tr), any_value(tg))), 4) as overlap_ratio,
       round(case when min(greatest(0.0, rs - ge, gs - re)) = 0 then 1.0 else greatest(0.0, 1 - min(greatest(0.0, rs - ge, gs - re)) / 3600.0) end, 4) as proximity
from meas m join t on m.key = t.key group by m.key""")
def overlap_ratio_and_proximity(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(c) for c in ("r_s", "r_e", "g_s", "g_e")]
    t = intervals(spark, d).groupBy("key").agg(F.sum(F.when(F.col("lane") == 0, F.col("e") - F.col("s"))).alias("tr"), F.sum(F.when(F.col("lane") == 1, F.col("e") - F.col("s"))).alias("tg"))
    near = F.min(iv.gap(*cols))
    m = lane_pairs(spark, d).groupBy("key").agg(F.sum(iv.intersection(*cols)).alias("i"), near.alias("g")).join(t, "key")
    return m.select("key", r4(F.col("i") / F.greatest(F.lit(1e-6), F.least("tr", "tg")), "overlap_ratio"), r4(F.when(F.col("g") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("g") / 3600.0)), "proximity"))


@query(PAIRS + " select key, case when bool_or(inter > 0) then null else round(min(greatest(0.0, rs - ge, gs - re)), 4) end as nearest from meas group by key")
def nearest_gap(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(c) for c in ("r_s", "r_e", "g_s", "g_e")]
    return lane_pairs(spark, d).groupBy("key").agg(F.when(F.bool_or(iv.intersection(*cols) > 0), None).otherwise(F.round(F.min(iv.gap(*cols)), 4)).alias("nearest"))


@query(""", m as (select *, case when s <= max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) + 3600 then 0 else 1 end as fresh from iv
), i as (select *, sum(fresh) over (partition by user_id order by s, e rows unbounded preceding) as island from m)
select user_id, round(min(s), 4) as s, round(max(e), 4) as e, count(*) as n from i group by user_id, island""")
def span_islands_merge(spark: SparkSession, d: str) -> DataFrame:
    out = op.islands(intervals(spark, d), ["user_id"], tolerance=3600.0)
    return out.select("user_id", r4(F.col("s"), "s"), r4(F.col("e"), "e"), "n")


@query(""", c as (select key, id, greatest(s, floor(s / 86400) * 86400 + 21600) as s, least(e, floor(s / 86400) * 86400 + 79200) as e from iv
), k as (select *, count(*) filter (where e - s >= 14400) over (partition by key) as strict from c)
select key, id, round(s, 1) as s, round(e, 1) as e from k where e - s >= case when strict > 0 then 14400 else 7200 end""")
def span_clip_min_relax(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.col("s") / 86400) * 86400
    c = intervals(spark, d).select("key", "id", F.greatest("s", day + 21600).alias("s"), F.least("e", day + 79200).alias("e"))
    long = F.col("e") - F.col("s")
    c = c.withColumn("strict", F.count_if(long >= 14400).over(Window.partitionBy("key")))
    return c.where(long >= F.when(F.col("strict") > 0, 14400).otherwise(7200)).select("key", "id", F.round("s", 1).alias("s"), F.round("e", 1).alias("e"))


@query(", m as (select *, lead(s) over (partition by user_id order by s, id) as nxt from iv) select user_id, round(s, 4) as s, round(nxt, 4) as e from m where nxt - s >= 3600")
def boundaries_to_segments(spark: SparkSession, d: str) -> DataFrame:
    x = intervals(spark, d).withColumn("at", F.struct("s", "id"))
    w = Window.partitionBy("user_id").orderBy("at")
    out = x.withColumn("nxt", F.lead("s").over(w)).where(F.col("nxt") - F.col("s") >= 3600)
    return out.select("user_id", r4(F.col("s"), "s"), r4(F.col("nxt"), "e"))


@query(", m as (select *, lag(value) over w as b, lead(value) over w as a from iv window w as (partition by user_id order by s)) select id, user_id, value from m where value > coalesce(b, '-inf'::double) and value >= coalesce(a, '-inf'::double) and value >= 50")
def local_peaks_above_threshold(spark: SparkSession, d: str) -> DataFrame:
    return op.peaks(intervals(spark, d), ["user_id"], "s", "value", least=50.0).select("id", "user_id", "value")


@query(", w as (select key, value, unnest(range(greatest(floor((s - 21600) / 10800)::bigint + 1, 0), floor(s / 10800)::bigint + 1)) * 10800.0 as win_start from iv) select win_start, count(*) as n, round(sum(value), 4) as total from w group by win_start")
def hopping_windows(spark: SparkSession, d: str) -> DataFrame:
    out = op.hop_windows(intervals(spark, d).select("key", "value", "s"), "s", size=21600.0, hop=10800.0)
    return out.groupBy("win_start").agg(F.count("*").alias("n"), r4(F.sum("value"), "total"))


@query(", m as (select *, case when s - lag(s) over (partition by user_id order by s) < 14400 then 0 else 1 end as fresh from iv), i as (select *, sum(fresh) over (partition by user_id order by s rows unbounded preceding) as k from m) select user_id, count(*) as n, round(min(s), 4) as s, round(max(s) + 14400, 4) as e from i group by user_id, k")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = ev.groupBy("user_id", F.session_window("t", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    at = lambda c: F.unix_micros(F.col(c)) / 1e6 - 1704067200.0
    return out.select("user_id", "n", r4(at("w.start"), "s"), r4(at("w.end"), "e"))


@query(", m as (select id, avg(value) over w as mean, count(*) over w as n from iv window w as (partition by user_id order by s rows between 2 preceding and 2 following)) select id, round(mean, 4) as mean from m where n = 5")
def centered_mean(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("s").rowsBetween(-2, 2)
    out = intervals(spark, d).select("id", F.avg("value").over(w).alias("mean"), F.count("*").over(w).alias("n"))
    return out.where("n = 5").select("id", r4(F.col("mean"), "mean"))


@query(""", k as (select id, user_id, s, value, event_type <> 'error' as known from iv
), b as (select k.id, p.s as t, p.value as v from k asof join (select * from k where known) p on k.user_id = p.user_id and k.s >= p.s
), a as (select k.id, p.s as t, p.value as v from k asof join (select * from k where known) p on k.user_id = p.user_id and k.s <= p.s)
select k.id, case when k.s - b.t <= 43200 and (a.t is null or k.s - b.t <= a.t - k.s) then b.v when a.t - k.s <= 43200 then a.v end as filled from k left join b using (id) left join a using (id)""")
def asof_nearest_fill(spark: SparkSession, d: str) -> DataFrame:
    return op.nearest_fill(intervals(spark, d), ["user_id"], "s", "value", F.col("event_type") != "error", most=43200.0, out="filled").select("id", "filled")


@query(", g as (select id, round_even(value / 0.1, 0)::bigint as grid from iv) select grid, count(*) as n from g group by grid")
def nearest_grid_snap(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).groupBy(F.bround(F.col("value") / 0.1, 0).cast("long").alias("grid")).agg(F.count("*").alias("n"))


@query(", n as (select user_id, list(value order by s, id) as v from iv group by user_id), k as (select user_id, v, unnest(range(0, 8)) as i from n) select user_id, i, v[floor(i * (len(v) - 1) / 7.0 + 0.5)::bigint + 1] as value from k")
def linspace_resample(spark: SparkSession, d: str) -> DataFrame:
    """Eight values evenly spread over a user's events, first and last included."""
    w = Window.partitionBy("user_id")
    x = intervals(spark, d).withColumn("k", F.row_number().over(w.orderBy("s", "id")) - 1).withColumn("n", F.count("*").over(w))
    picks = x.select("user_id", "n").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("k", F.floor(F.col("i") * (F.col("n") - 1) / 7.0 + 0.5).cast("int"))
    return picks.join(x.select("user_id", "k", "value"), ["user_id", "k"]).select("user_id", F.col("i").cast("long").alias("i"), "value")


@query(", m as (select *, row_number() over (partition by user_id order by s, id) - 1 as t from iv) select id, user_id, t from m where (t - 3) % 8 = 0")
def stride_select(spark: SparkSession, d: str) -> DataFrame:
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("s", "id")).cast("long") - 1
    return intervals(spark, d).select("id", "user_id", t.alias("t")).where(F.pmod(F.col("t") - 3, F.lit(8)) == 0)


@query(", m as (select key, min(s) as lo, max(e) as hi from iv group by key) select id, round((s - lo) / (hi - lo), 4) as s, round((e - lo) / (hi - lo), 4) as e from iv join m using (key) where hi > lo")
def timeline_normalize(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("key")
    x = intervals(spark, d).withColumns({"lo": F.min("s").over(w), "hi": F.max("e").over(w)}).where("hi > lo")
    return x.select("id", r4((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")), "s"), r4((F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo")), "e"))


@query(" select event_type, count(*) as n, round(sum(value * 600.0), 2) as seconds from events where value * 600.0 >= 3600 group by event_type")
def duration_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("value") * 600.0 >= 3600).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * 600.0), 2).alias("seconds"))


@query(", m as (select *, row_number() over (partition by key order by s, e, id) as k from iv) select id, key, 'm' || lpad(k::varchar, 4, '0') as name from m")
def sequential_renumber(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("key").orderBy("s", "e", "id"))
    return intervals(spark, d).select("id", "key", F.concat(F.lit("m"), F.lpad(k.cast("string"), 4, "0")).alias("name"))


@query(" select user_id, count(*) as n from events where event_type = 'purchase' group by user_id having count(*) > 2")
def samples_with_more_than_two_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 2")


@query(", w as (select user_id, event_type, floor(s / 86400)::bigint as win, count(*) as n from iv group by all) select user_id, event_type, win, max(n) over (partition by user_id, event_type order by win) as need from w")
def running_need_max(spark: SparkSession, d: str) -> DataFrame:
    n = intervals(spark, d).groupBy("user_id", "event_type", F.floor(F.col("s") / 86400).alias("win")).agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", "win", F.max("n").over(Window.partitionBy("user_id", "event_type").orderBy("win")).alias("need"))


@query(", p as (select *, row_number() over (partition by key order by e - s desc, id) as k from iv) select key, id, k as rank from p where k <= 3")
def topk_longest_per_sample(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.col("e") - F.col("s")), "id"))
    return intervals(spark, d).select("key", "id", k.alias("rank")).where("rank <= 3")


@query(""", r as (select *, row_number() over (partition by key, lane order by s, id) as rn, count(*) over (partition by key, lane) as n from iv)
select a.key, a.id as time_id, b.id as text_id from r a join r b on a.key = b.key and a.lane = 0 and b.lane = 1 and a.n = b.n and a.rn = b.rn""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Times and texts whose ids do not meet are paired by position, where a sample has as many of either."""
    w = Window.partitionBy("key", "lane")
    r = intervals(spark, d).select("key", "lane", "id", F.row_number().over(w.orderBy("s", "id")).alias("rn"), F.count("*").over(w).alias("n"))
    return r.where("lane = 0").withColumnRenamed("id", "time_id").drop("lane").join(r.where("lane = 1").withColumnRenamed("id", "text_id").drop("lane"), ["key", "rn", "n"]).select("key", "time_id", "text_id")
