"""Queries of the merge and platform side: averages, leaderboards, merges, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, r4, table

DIMS = ("semantic", "motion", "event", "world")
_SCORES = """
with sc as (
  select s_name as model, l_orderkey as sample, round(l_quantity * 2, 6) as semantic, round(nullif(l_discount, 0) * 1000, 6) as motion, round(nullif(l_tax, 0) * 1000, 6) as event, round(1 + l_linenumber % 5, 6) as world
  from lineitem join supplier on l_suppkey = s_suppkey
), av as (select model, count(sample) as n, avg(semantic) as semantic, avg(motion) as motion, avg(event) as event, avg(world) * 20 as world from sc group by model
), tot as (select *, (semantic + motion + event + world) / 4 as total from av)
"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of (model, sample): line items of suppliers; a discount or tax of 0 stands for a missing score."""
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    parts = {"semantic": F.col("l_quantity") * 2, "motion": F.nullif("l_discount", F.lit(0.0)) * 1000, "event": F.nullif("l_tax", F.lit(0.0)) * 1000, "world": 1 + F.col("l_linenumber") % 5}
    return j.select(F.col("s_name").alias("model"), F.col("l_orderkey").alias("sample"), *(F.round(c.cast("double"), 6).alias(n) for n, c in parts.items()))


def model_averages(scores: DataFrame) -> DataFrame:
    """Means per model that skip nulls, of values rounded to 6 places; the world band as hundredths."""
    av = scores.groupBy("model").agg(F.count("sample").alias("n"), *(F.avg(c).alias(c) for c in DIMS))
    return av.withColumn("world", F.col("world") * 20).withColumn("total", (F.col("semantic") + F.col("motion") + F.col("event") + F.col("world")) / 4)


@query(_SCORES + "select model, n, round(total, 4) as total, row_number() over (order by round(total, 4) desc, model)::int as rank from tot")
def leaderboard_total(spark: SparkSession, d: str) -> DataFrame:
    av = model_averages(_scores(spark, d)).select("model", "n", r4(F.col("total"), "total"))  # one row per model
    return av.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "model")))


@query(_SCORES + ", l as (" + " union all ".join(f"select '{c}' as dimension, model, round({c}, 4) as score from tot" for c in DIMS) + ") select dimension, model, score, row_number() over (partition by dimension order by score desc, model)::int as rank from l")
def leaderboard_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    long = model_averages(_scores(spark, d)).unpivot("model", list(DIMS), "dimension", "score").select("dimension", "model", r4(F.col("score"), "score"))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("score"), "model")))


@query(_SCORES + "select model, n, round(semantic, 4) as semantic, round(motion, 4) as motion, round(event, 4) as event, round(world, 4) as world from av")
def model_avg_nullskip(spark: SparkSession, d: str) -> DataFrame:
    return model_averages(_scores(spark, d)).select("model", "n", *(r4(F.col(c), c) for c in DIMS))


@query(_SCORES + "select model, count(*) as n from sc where motion is not null or event is not null group by model")
def drop_all_null_rows(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).dropna("all", subset=["motion", "event"]).groupBy("model").agg(F.count("*").alias("n"))


@query("""
with src as (
  select l_orderkey as sample, 1 as prio, max(nullif(l_discount, 0)) as a, max(l_quantity) as b, null::double as c from lineitem group by 1
  union all select o_orderkey, 2, case when o_orderstatus = 'F' then o_totalprice / 1e6 end, null, o_totalprice from orders
  union all select p_partkey, 3, null, p_size::double, p_retailprice from part
  union all select event_id, 4, value, null, value from events
)
select sample, round(arg_min(a, prio) filter (where a is not null), 6) as a, round(arg_min(b, prio) filter (where b is not null), 6) as b, round(arg_min(c, prio) filter (where c is not null), 6) as c from src group by sample""")
def merge_four_sources_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("double")
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.max(F.nullif("l_discount", F.lit(0.0))).alias("a"), F.max("l_quantity").alias("b")).select("sample", F.lit(1).alias("prio"), "a", "b", none.alias("c"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.lit(2).alias("prio"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 1e6).alias("a"), none.alias("b"), F.col("o_totalprice").alias("c"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("sample"), F.lit(3).alias("prio"), none.alias("a"), F.col("p_size").cast("double").alias("b"), F.col("p_retailprice").alias("c"))
    events = table(spark, d, "events").select(F.col("event_id").alias("sample"), F.lit(4).alias("prio"), F.col("value").alias("a"), none.alias("b"), F.col("value").alias("c"))
    src = line.unionByName(orders).unionByName(part).unionByName(events)
    first = lambda c: F.round(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("prio"))), 6).alias(c)
    return src.groupBy("sample").agg(first("a"), first("b"), first("c"))


@query("select r_name as theme, count(*) as n, grouping(r_name)::int as is_total from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup(r_name)")
def theme_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("r_name").alias("theme")).rollup("theme").agg(F.count("*").alias("n"), F.grouping("theme").cast("int").alias("is_total"))


@query("select count(*) as total, count(*) filter (where o_orderstatus = 'P') as pending, count(*) filter (where o_orderstatus = 'O') as running, count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus not in ('P', 'O', 'F')) as failed from orders")
def task_status_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count("*").alias("total"), *(F.count_if(s == k).alias(n) for k, n in (("P", "pending"), ("O", "running"), ("F", "completed"))), F.count_if(~s.isin("P", "O", "F")).alias("failed"))


@query("select o_orderkey, count(*) as n, round(sum(l_quantity), 2) as q from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def pair_inner_join(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))  # sums before the join
    return table(spark, d, "orders").select("o_orderkey").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n", "q")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def missing_gen_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def ref_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


_OLD, _NEW = "l_shipdate < timestamp '1998-01-01'", "l_shipdate >= timestamp '1997-01-01'"


@query(f"""
with old as (select l_orderkey as k, sum(l_quantity) as v from lineitem where {_OLD} group by 1), new as (select l_orderkey as k, sum(l_quantity) as v from lineitem where {_NEW} group by 1)
select coalesce(n.k, o.k) as k, round(coalesce(n.v, o.v), 2) as v, case when n.k is null then 'kept' when o.k is null then 'added' else 'replaced' end as how from old o full join new n on o.k = n.k""")
def upsert_summary(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    side = lambda cond, v: line.where(cond).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias(v))
    how = F.when(F.col("nv").isNull(), "kept").when(F.col("ov").isNull(), "added").otherwise("replaced")
    return side(_OLD, "ov").join(side(_NEW, "nv"), "k", "full").select("k", F.round(F.coalesce("nv", "ov"), 2).alias("v"), how.alias("how"))


@query(f"select distinct l_orderkey as k, l_suppkey as model from lineitem where {_NEW} and (l_orderkey, l_suppkey) not in (select l_orderkey, l_suppkey from lineitem where {_OLD})")
def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("model"), "l_shipdate")
    return line.where(_NEW).select("k", "model").distinct().join(line.where(_OLD), ["k", "model"], "left_anti")


@query("""
with cur as (select l_orderkey as k, max(nullif(l_discount, 0)) as v from lineitem where l_returnflag = 'A' group by 1), prev as (select l_orderkey as k, max(l_tax) as v from lineitem where l_returnflag <> 'A' group by 1)
select o_orderkey as k, coalesce(c.v, p.v) as v, c.v is null and p.v is not null as filled from orders left join cur c on o_orderkey = c.k left join prev p on o_orderkey = p.k""")
def left_join_fill_previous(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    cur = line.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.nullif("l_discount", F.lit(0.0))).alias("c"))
    prev = line.where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_tax").alias("p"))
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).join(cur, "k", "left").join(prev, "k", "left")
    return out.select("k", F.coalesce("c", "p").alias("v"), (F.col("c").isNull() & F.col("p").isNotNull()).alias("filled"))


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as task, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders group by o_custkey")
def latest_task_state(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("task"), F.max_by("o_orderstatus", at).alias("status"))


@query("select user_id, event_type, min(event_id) as first_id, count(*) - 1 as refused from events group by user_id, event_type, floor(value)")
def duplicate_guard(spark: SparkSession, d: str) -> DataFrame:
    """The first submission of a key stands, later ones are refused and counted."""
    return table(spark, d, "events").groupBy("user_id", "event_type", F.floor("value").alias("v")).agg(F.min("event_id").alias("first_id"), (F.count("*") - 1).alias("refused")).drop("v")


@query("with r as (select l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as k from lineitem) select l_returnflag, l_orderkey, l_linenumber, l_extendedprice, k::int as rank from r where k <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The limit on rows in the window lets Spark keep only three of each group per task before the shuffle."""
    k = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").withColumn("rank", k).where("rank <= 3").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("""
with u as (select o_custkey, o_orderkey, o_totalprice as w, (('0x' || substring(md5('2025:' || o_orderkey), 1, 12))::bigint + 1) / 281474976710657.0 as u from orders)
, r as (select *, row_number() over (partition by o_custkey order by round(-ln(u) / w, 12), o_orderkey) as k from u) select o_custkey, o_orderkey from r where k <= 2""")
def weighted_sample_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Two orders of each customer by the keys -ln(u) / weight, where u comes from a seeded hash of the id."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("2025:"), F.col("o_orderkey").cast("string"))), 1, 12), 16, 10).cast("bigint") + 1) / 281474976710657.0
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.round(-F.ln(u) / F.col("o_totalprice"), 12), "o_orderkey"))
    return table(spark, d, "orders").withColumn("k", k).where("k <= 2").select("o_custkey", "o_orderkey")
