"""Queries of the world dimension, tolerant parsers, folds and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..streaming import jobs
from .registry import intervals, query, r4, table


@query("select event_id, greatest(0, least(100, (props->>'$.k')::double::int))::int as consistency from events")
def judgement_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("```json\n{\"consistency\": "), F.get_json_object("props", "$.k"), F.lit("}```"))
    return table(spark, d, "events").select("event_id", tx.judged_consistency(raw).alias("consistency"))


@query("""with m as (select user_id, avg((props->>'$.k')::double) as a, count(*) as n from events where event_type <> 'error' group by user_id)
select user_id, n, round(a, 4) as mean, case when a >= 80 then 5 when a >= 60 then 4 when a >= 40 then 3 when a >= 20 then 2 else 1 end as band from m""")
def world_band(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    m = table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.avg(k).alias("a"))
    return m.select("user_id", "n", r4(F.col("a"), "mean"), tx.band(F.col("a")).alias("band"))


@query(r"""select page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), '\.[A-Za-z0-9]{1,5}$', '') as stem from pages""")
def stem_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.stem(F.col("url")).alias("stem"))


@query(r"""with p as (select regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), '\.[A-Za-z0-9]{1,5}$', '') as stem from pages), n as (select try_cast(stem as bigint) as k from p where try_cast(stem as bigint) is not null)
select k % 1000 as doc_id, count(*) as n from n join documents on k % 1000 = doc_id group by 1""")
def stem_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(tx.stem(F.col("url")).try_cast("bigint").alias("k")).where("k is not null")
    hits = p.groupBy((F.col("k") % 1000).alias("doc_id")).agg(F.count("*").alias("n"))
    return hits.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")


@query(r"select event_id, round(try_cast(trim(regexp_replace(case when event_id % 7 = 0 then 'n/a' when event_id % 3 = 0 then value || '%' else ' ' || value || ' ' end, '[,%]', '', 'g'), ' ') as double), 4) as x from events")
def tolerant_float_parse(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", r4(tx.tolerant_float(cell), "x"))


@query("""with i as (select event_type as type, case when event_id % 9 = 0 then null else (props->>'$.k')::double end as score from events)
select type, count(*) as n, count(*) filter (where score >= 80) as kept, round(avg(score) filter (where score >= 80), 4) as mean from i group by type""")
def bank_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """Bank items with a total score of 80 or more; one without a score is not kept."""
    e = table(spark, d, "events")
    item = F.to_json(F.struct(F.col("event_type").alias("type"), F.when(F.col("event_id") % 9 != 0, F.get_json_object("props", "$.k").cast("double")).alias("total_score_100")))
    x = e.select(F.from_json(item, "struct<type:string,total_score_100:double>").alias("i")).select("i.*")
    good = F.col("total_score_100") >= 80
    return x.groupBy("type").agg(F.count("*").alias("n"), F.count_if(good).alias("kept"), r4(F.avg(F.when(good, F.col("total_score_100"))), "mean"))


@query(", m as (select *, case when s <= max(e) over (partition by key order by s, e, id rows between unbounded preceding and 1 preceding) + 43200 then 0 else 1 end as fresh from iv where e - s >= 2e-3), i as (select *, sum(fresh) over (partition by key order by s, e, id rows unbounded preceding) as k from m) select key, round(min(s), 4) as s, round(max(e), 4) as e, count(*) as n from i group by key, k")
def gap_adjacent_merge(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import islands

    out = islands(intervals(spark, d).where("e - s >= 2e-3"), ["key"], tolerance=43200.0)
    return out.select("key", r4(F.col("s"), "s"), r4(F.col("e"), "e"), "n")


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
def stream_incremental_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums kept by a streaming aggregation that reads all files there are and stops."""
    out = jobs.run_available(jobs.status_counts(jobs.read_stream(spark, d, "events"), "event_type", "value"), "status", mode="complete")
    return out.select("event_type", "n", F.round("total", 2).alias("total"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of the full history from event-time windows without a watermark, written by upsert of each micro-batch's changed windows."""
    out = jobs.run_upserts(jobs.daily_counts(jobs.read_stream(spark, d, "events")), ["day"], "daily")
    return out.select(F.col("day").cast("string").alias("day"), "n")
