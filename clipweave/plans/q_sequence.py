"""Queries of scenes, segments, windows, alignment, merging with its map and statistics, and state logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import vectors as v
from ..functions import table_functions as tf
from ..operators import cache, merger
from ..operators import sequence as sq
from ..streaming import stateful as st
from ..streaming.jobs import place_of
from .registry import intervals, lane_pairs, query, r4, table


@query("""
with x as (select user_id as clip, ((epoch_us(ts) // 1000000 - 1704067200) // 3600)::int as t, event_type from events), cl as (select clip, max(t) - 10 as n, 1 + clip % 3 as fps from x group by clip
), cut as (
  select distinct x.clip, t, 1 as o from x join cl using (clip) where event_type = 'purchase' and t < n union all select clip, 0, 0 from cl where n > 0 union all select clip, n, 2 from cl where n > 0
), m as (select *, lead(t) over (partition by clip order by t, o) as e from cut)
select m.clip, round(t / fps, 4) as s, round(e / fps, 4) as e from m join cl on cl.clip = m.clip where e is not null""")
def scene_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of each user's hours, cut at purchases, over all but the last ten hours."""
    t = F.floor((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) - 1704067200) / 3600).cast("int")
    x = table(spark, d, "events").select(F.col("user_id").alias("clip"), t.alias("t"), "event_type")
    clips = x.groupBy("clip").agg((F.max("t") - 10).alias("n_frames")).withColumn("fps", (1 + F.col("clip") % 3).cast("double"))
    out = sq.scenes(x.where("event_type = 'purchase'").select("clip", "t"), clips)
    return out.select("clip", r4(F.col("s"), "s"), r4(F.col("e"), "e"))


@query(""", cl as (select user_id as clip, floor(min(s) / 86400) * 86400 as t0, floor(max(s) / 86400) * 86400 as t1 from iv group by user_id
), b as (select distinct clip, greatest(t0, least(t1, s)) as s from cl join iv on iv.user_id = cl.clip union select clip, t0 from cl union select clip, t1 from cl
), m as (select *, lead(s) over (partition by clip order by s) as e from b) select clip, round(s, 4) as s, round(e, 4) as e from m where e - s >= 3600""")
def boundary_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments between a user's events, with the first and the last part of the days that they span."""
    x = intervals(spark, d)
    day = lambda c: F.floor(c / 86400) * 86400.0
    clips = x.groupBy(F.col("user_id").alias("clip")).agg(day(F.min("s")).alias("t0"), day(F.max("s")).alias("t1"))
    out = sq.segments_between(x.select(F.col("user_id").alias("clip"), F.col("s").alias("at")), clips, least=3600.0)
    return out.select("clip", r4(F.col("s"), "s"), r4(F.col("e"), "e"))


@query("""with c as (select user_id as clip, round(sum(value) / 50, 3) as dur from events group by user_id
), k as (select *, unnest(range(0, greatest(0, ceil((dur - 6) / 3))::int + 1)) as k from c) select clip, k::int as k, k * 3.0 as s, round(least(dur, k * 3 + 6), 4) as e from k""")
def clip_windows(spark: SparkSession, d: str) -> DataFrame:
    clips = table(spark, d, "events").groupBy(F.col("user_id").alias("clip")).agg(F.round(F.sum("value") / 50, 3).alias("dur"))
    return sq.clip_windows(clips).select("clip", "k", "s", r4(F.col("e"), "e"))


@query(""", f as (select user_id as clip, row_number() over (partition by user_id order by s, id) - 1 as t, sqrt(value) as value from iv
), w as (select *, unnest(range(greatest(0, floor((t - 20) / 10)::bigint + 1), t // 10 + 1)) as win from f
), y as (select *, value - avg(value) over (partition by clip, win) as y from w) select clip, t, round(avg(y), 4) as score from y group by clip, t""")
def overlap_average(spark: SparkSession, d: str) -> DataFrame:
    """Roots of values less the mean of their window, averaged over the windows that overlap there."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("s", "id")) - 1
    f = intervals(spark, d).select(F.col("user_id").alias("clip"), t.alias("t"), F.sqrt("value").alias("value"))
    score = F.col("value") - F.avg("value").over(Window.partitionBy("clip", "win"))
    return sq.overlap_average(f, score, size=20, stride=10).select("clip", F.col("t").cast("long").alias("t"), r4(F.col("score"), "score"))


@query(""", a as (select key, id, s as ord from iv where lane = 0), b as (select key, case when key % 2 = 0 then id - 1 else id end as id, s as ord from iv where lane = 1
), i as (select a.key, a.id as time_id, b.id as text_id, 'id' as how from a join b on a.key = b.key and a.id = b.id
), ra as (select *, row_number() over (partition by key order by ord) as rn, count(*) over (partition by key) as n from a where key not in (select key from i)
), rb as (select *, row_number() over (partition by key order by ord) as rn, count(*) over (partition by key) as n from b where key not in (select key from i))
select key as clip, time_id, text_id, how from i union all select ra.key, ra.id, rb.id, 'position' from ra join rb on ra.key = rb.key and ra.rn = rb.rn and ra.n = rb.n""")
def aligned_texts(spark: SparkSession, d: str) -> DataFrame:
    """Times and texts of a sample by id, or else by position."""
    x = intervals(spark, d)
    a = x.where("lane = 0").select(F.col("key").alias("clip"), "id", F.col("s").alias("ord"))
    b = x.where("lane = 1").select(F.col("key").alias("clip"), F.when(F.col("key") % 2 == 0, F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.col("s").alias("ord"))
    return sq.align(a, b)


_ITEMS = """, em as (select vec_id, embedding::double[] as x from embeddings), it as (
  select key, id, s, e, x, row_number() over (partition by key order by e - s < 2e-3, s, e, id) as rn, e - s < 2e-3 as short from iv left join em using (vec_id)
), rec as (
  select key, id, rn, s, e, case when short or x is null then 0 else 1 end as c, e as upto, case when short or x is null then null else list_transform(x, lambda y: y * (e - s)) end as v,
         case when short then 'short' when x is null then 'no_vector' else 'first' end as reason, case when short or x is null then null else 1 end as cluster from it where rn = 1
  union all
  select n.key, n.id, n.rn, n.s, n.e, n.c, n.upto, n.v, n.reason, case when n.reason = 'short' or n.c = 0 then null else n.c end from (
    select i.key, i.id, i.rn, i.s, i.e,
      case when i.short then 'short' when i.x is null then 'no_vector' when r.c = 0 then 'first' when r.v is null then 'low_similarity'
           when (list_cosine_similarity(r.v, i.x) + 1) / 2 < 0.55 then 'low_similarity' when i.s - r.upto > 43200 then 'large_gap' else 'merged' end as reason,
      case when i.short or (i.x is null and r.c = 0) then r.c when i.x is not null and r.v is not null and (list_cosine_similarity(r.v, i.x) + 1) / 2 >= 0.55 and i.s - r.upto <= 43200 then r.c else r.c + 1 end as c,
      case when i.short or (i.x is null and r.c = 0) then r.upto when i.x is not null and r.v is not null and (list_cosine_similarity(r.v, i.x) + 1) / 2 >= 0.55 and i.s - r.upto <= 43200 then greatest(r.upto, i.e) else i.e end as upto,
      case when i.short then r.v when i.x is null then null
           when r.v is not null and (list_cosine_similarity(r.v, i.x) + 1) / 2 >= 0.55 and i.s - r.upto <= 43200 then list_transform(list_zip(r.v, i.x), lambda p: p[1] + p[2] * (i.e - i.s))
           else list_transform(i.x, lambda y: y * (i.e - i.s)) end as v
    from rec r join it i on i.key = r.key and i.rn = r.rn + 1) n)
"""
_RECURSIVE = {"similarity": 0.55, "gap": 43200.0, "least": 2e-3}


def _items(spark: SparkSession, d: str) -> DataFrame:
    em = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))  # as they are: half the bytes of doubles
    return intervals(spark, d).join(em, "vec_id", "left").select("key", "id", "s", "e", "x")


@query(_ITEMS + "select key, id, cluster::bigint as cluster, reason from rec", recursive=True)
def merge_map(spark: SparkSession, d: str) -> DataFrame:
    return merger.merge_items(_items(spark, d), **_RECURSIVE)


@query(_ITEMS + "select key, 'm' || lpad(cluster::varchar, 4, '0') as name, round(min(s), 4) as s, round(max(e), 4) as e, count(*) as n, string_agg(id::varchar, ',' order by s, e, id) as members from rec where cluster is not null group by key, cluster", recursive=True)
def semantic_adjacent_merge(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    out = merger.clusters(items, merger.merge_items(items, **_RECURSIVE))
    return out.select("key", "name", r4(F.col("s"), "s"), r4(F.col("e"), "e"), "n", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(_ITEMS + """, w0 as (select r.key, cluster, x, r.e - r.s as dur, unnest(range(1, len(x) + 1)) as i from rec r join it using (key, id) where cluster is not null and x is not null
), w as (select key, cluster, i, x[i] * dur as y from w0
), t as (select key, cluster, i, sum(y) as y from w group by all), l as (select key, cluster, sqrt(sum(y * y)) as len from t group by all)
select t.key, 'm' || lpad(t.cluster::varchar, 4, '0') as name, round(y / len, 4) as x from t join l using (key, cluster) where i = 1 and len > 0""", recursive=True)
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """First component of each cluster's centroid."""
    items = _items(spark, d)
    return merger.centroids(items, merger.merge_items(items, **_RECURSIVE)).where("i = 0").select("key", "name", r4(F.col("x"), "x"))


@query(_ITEMS + """select key, count(*) as items, count(cluster) as kept, coalesce(max(cluster), 0)::bigint as clusters, count(*) filter (where reason = 'short') as short, count(*) filter (where reason = 'no_vector') as no_vector,
 count(*) filter (where reason = 'low_similarity') as low_similarity, count(*) filter (where reason = 'large_gap') as large_gap, count(*) filter (where reason = 'merged') as merged from rec group by key""", recursive=True)
def merge_statistics(spark: SparkSession, d: str) -> DataFrame:
    return merger.statistics(merger.merge_items(_items(spark, d), **_RECURSIVE))


@query("""with l as (select user_id * 10 + event_id % 10 as task, ts, event_id, case event_type when 'error' then 'failed' when 'purchase' then 'completed' when 'click' then 'processing' else 'pending' end as status from events
), m as (select *, lag(status) over (partition by task order by ts, event_id) as before from l)
select task, event_id, before, case when before is null then status = 'pending' else before || '>' || status in ('pending>processing', 'processing>completed', 'processing>failed', 'pending>failed') end as legal from m""")
def task_transitions(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    log = table(spark, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("task"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), status.alias("status"))
    return sq.transitions(log).select("task", F.col("seq").alias("event_id"), "before", "legal")


_LOG = """with l as (select user_id % 200 as task, epoch_us(ts) as us, event_id, case event_type when 'error' then 'failed' when 'purchase' then 'completed' when 'click' then 'processing' else 'pending' end as status from events
)"""
#: A task that stays open for half a day has failed.
_LIMIT = 43200.0


def _task_log(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "processing").otherwise("pending")
    return table(spark, d, "events").select((F.col("user_id") % 200).alias("task"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), status.alias("status"))


_TIMED = _LOG + f""", m as (
  select *, coalesce(after > us + {int(_LIMIT * 1e6)}, true) and status in ('pending', 'processing') as gone
  from (select *, lag(status) over (partition by task order by us, event_id) as was, lead(us) over (partition by task order by us, event_id) as after from l)
), b as (select *, case when lag(gone) over (partition by task order by us, event_id) then 'failed' else was end as before from m
), r as (
  select task, us, event_id as seq, status, before, false as timed_out from b
  union all select task, us + {int(_LIMIT * 1e6)}, -1, 'failed', status, true from b where gone
)
select task, us as at, seq, status, before, case when before is null then status = 'pending' else before || '>' || status in ('pending>processing', 'processing>completed', 'processing>failed', 'pending>failed') end as legal, timed_out from r"""


@query(_TIMED)
def task_time_outs(spark: SparkSession, d: str) -> DataFrame:
    """The log of tasks with those that ran out of time, in one batch."""
    return sq.transitions_with_time_outs(_task_log(spark, d), limit=_LIMIT).withColumn("at", F.unix_micros("at"))


@query(_TIMED)
def stream_task_machine(spark: SparkSession, d: str) -> DataFrame:
    """The same from shuffled micro-batches, by state and timers."""
    log = _task_log(spark, d).select(F.col("task").alias("key"), F.col("at").alias("ts"), "seq", "status")
    out = st.replay(spark, log, st.TaskMachine(_LIMIT), late="60 days", result=st.TaskMachine.RESULT, name="tasks")
    return out.select(F.col("key").cast("long").alias("task"), "at", "seq", "status", "before", "legal", "timed_out")


@query("""with recursive l as (
  select user_id % 200 as name, epoch_us(ts) as us, event_id, case event_type when 'error' then 'failed' when 'purchase' then 'completed' else 'submit' end as kind, row_number() over (partition by user_id % 200 order by ts, event_id) as k from events
), g as (
  select name, us, event_id, kind, k, kind = 'submit' as accepted, case when kind = 'submit' then 'open' end as state from l where k = 1
  union all
  select l.name, l.us, l.event_id, l.kind, l.k, l.kind = 'submit' and coalesce(g.state, 'failed') = 'failed',
         case when l.kind = 'submit' and coalesce(g.state, 'failed') = 'failed' then 'open' when g.state = 'open' and l.kind <> 'submit' then l.kind else g.state end
  from g join l on l.name = g.name and l.k = g.k + 1
)
select name, us as at, event_id, kind, accepted from g""")
def stream_duplicate_guard(spark: SparkSession, d: str) -> DataFrame:
    """Submissions that a guard takes: none while one of its name is open or after one has been completed."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("submit")
    log = table(spark, d, "events").select((F.col("user_id") % 200).alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))
    out = st.replay(spark, log, st.Guard(), late="60 days", result=st.Guard.RESULT, name="guard")
    return out.select(F.col("key").cast("long").alias("name"), "at", F.col("seq").alias("event_id"), "kind", "accepted")


@query("select p_partkey, ('0x' || substring(md5(case when p_partkey % 2 = 0 then 'query: ' else 'passage: ' end || p_name), 1, 8))::bigint as code from part")
def encode_distinct_once(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in encoder runs once for every different (purpose, text)."""
    texts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "query: ").otherwise("passage: ").alias("purpose"), F.col("p_name").alias("text"))
    code = F.conv(F.substring(F.md5(F.concat("purpose", "text")), 1, 8), 16, 10).cast("long")
    return sq.encode_once(texts, code).select("p_partkey", F.col("vec").alias("code"))


def _hashed_words(missing: DataFrame) -> DataFrame:
    """An encoder of our own: how many words of a text fall into each of eight classes by their length."""
    words = F.split("text", " ")
    return missing.select("key", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.size(F.filter(words, lambda w: F.length(w) % 8 == k)).cast("double")).alias("result"))


@query("""with t as (select p_partkey, case when p_partkey % 2 = 0 then 'query' else 'passage' end as purpose, p_name as text, string_split(p_name, ' ') as w from part)
select p_partkey, len(list_filter(w, lambda x: length(x) % 8 = 5)) as fives, not exists (select 1 from t o where o.p_partkey % 3 = 0 and o.text = t.text and o.purpose = t.purpose) as fresh from t""")
def cached_encoding(spark: SparkSession, d: str) -> DataFrame:
    """A second run over all texts, after one over a third of them: only what is new to the store is encoded."""
    texts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "query").otherwise("passage").alias("purpose"), F.col("p_name").alias("text"))
    store = place_of(spark, "encodings")
    cache.with_cached(texts.where("p_partkey % 3 = 0"), _hashed_words, store, config="v1")
    out = cache.with_cached(texts, _hashed_words, store, config="v1")
    return out.select("p_partkey", F.get("result", F.lit(5)).cast("long").alias("fives"), "fresh")


@query("""with c as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[|。:;.]'), lambda p: trim(p, ' ')), lambda p: p <> '')[1:8] as c from conversations
), m as (select conv_id, turn, c, unnest(range(1, len(c) + 1)) as k from c), d as (select user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3600000000 as h from events group by user_id
), w as (select user_id, h, unnest(range(0, case when h > 0 then greatest(0, ceil((h - 48) / 24.0))::int + 1 else 1 end)) as k from d)
select conv_id || '_' || turn || '#' || k as id, length(c[k])::double as s, k::double as e from m union all select 'u' || user_id || '#' || k, k * 24.0, least(h, k * 24.0 + 48) from w""")
def sql_table_functions(spark: SparkSession, d: str) -> DataFrame:
    """Micro events of captions and windows of users' histories, in SQL text alone."""
    tf.register(spark)
    names = {n: f"parquet.`{d}/{n}.parquet`" for n in ("conversations", "events")}
    return spark.sql(f"""
        select m.event_id as id, cast(length(m.clause) as double) as s, cast(m.k as double) as e
        from {names["conversations"]} c, lateral micro_events(concat(c.conv_id, '_', c.turn), c.text) m
        union all
        select concat('u', u.user_id, '#', w.k), w.s, w.e
        from (select user_id, cast((max(unix_micros(cast(ts as timestamp))) - min(unix_micros(cast(ts as timestamp)))) div 3600000000 as double) as h from {names["events"]} group by user_id) u,
             lateral clip_windows(u.h, 48.0D, 24.0D) w""")


@query(""", p as (select r.key, r.s as rs, r.e as re, g.s as gs, g.e as ge from iv r join iv g on r.key = g.key and r.lane = 0 and g.lane = 1
), m as (select *, greatest(0.0, least(re, ge) - greatest(rs, gs)) as inter, greatest(re, ge) - least(rs, gs) as hull, greatest(0.05, 1800 / nullif(re - rs, 0), 1800 / nullif(ge - gs, 0)) as d from p)
select key, round(max((inter + d) / (hull + d)), 4) as best, round(min(d), 4) as least_delta from m group by key""")
def delta_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Relaxed IoU whose tolerance is the largest of a fixed one and of seconds by either duration; one without length has none."""
    rs, re, gs, ge = (F.col(c) for c in ("r_s", "r_e", "g_s", "g_e"))
    delta = iv.delta(re - rs, ge - gs, relative=0.05, seconds=1800.0)
    iou = (iv.intersection(rs, re, gs, ge) + delta) / (F.greatest(re, ge) - F.least(rs, gs) + delta)
    return lane_pairs(spark, d).groupBy("key").agg(r4(F.max(iou), "best"), r4(F.min(delta), "least_delta"))


@query(""", x as (select id, key, case when id % 3 = 0 then e else s end as s, case when id % 3 = 0 then s else e end as e from iv), sw as (select id, key, least(s, e) as s, greatest(s, e) as e from x
), t as (select key, max(e) - min(s) - 600 as total, min(s) as lo from sw group by key)
select id, round(greatest(0, least(1, (s - lo) / total)), 4) as s, round(greatest(0, least(1, (e - lo) / total)), 4) as e from sw join t using (key) where total > 0""")
def timeline_sanitized(spark: SparkSession, d: str) -> DataFrame:
    """Reversed events turned, and their times as shares of the clip's length, held to it."""
    turned = F.col("id") % 3 == 0
    x = intervals(spark, d).select("id", "key", F.when(turned, F.col("e")).otherwise(F.col("s")).alias("s"), F.when(turned, F.col("s")).otherwise(F.col("e")).alias("e"))
    w = Window.partitionBy("key")
    x = x.withColumns({"lo": F.min(F.least("s", "e")).over(w), "hi": F.max(F.greatest("s", "e")).over(w)})
    total = F.col("hi") - F.col("lo") - 600
    s, e = iv.sanitized(F.col("s") - F.col("lo"), F.col("e") - F.col("lo"), total)
    return x.where(total > 0).select("id", r4(s, "s"), r4(e, "e"))
