"""Queries of the motion dimension: velocities, histograms, distances, freeze gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series as se
from ..operators import motion as mo
from ..operators import quantiles
from .registry import intervals, query, r4, table

BINS = 8
#: Velocity stand-in: differences of consecutive events of a user; x is the value, y the gap in days; lanes by event id.
_VEL = """, o as (select user_id, lane, id, s, value, row_number() over w as t, value - lag(value) over w as dx, (s - lag(s) over w) / 86400.0 - 1.0 as dy from iv window w as (partition by user_id, lane order by s, id)
), vel as (select * from o where dx is not null)"""


def _velocity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "lane").orderBy("s", "id")
    o = intervals(spark, d).select("user_id", "lane", "id", "s", "value", F.row_number().over(w).alias("t"), (F.col("value") - F.lag("value").over(w)).alias("dx"), ((F.col("s") - F.lag("s").over(w)) / 86400.0 - 1.0).alias("dy"))
    return o.where("dx is not null")


@query(_VEL + " select user_id, lane, round(sum(dx * (1 + id % 3)) / (sum(1 + id % 3) + 1e-6), 4) as vx, round(sum(dy * (1 + id % 3)) / (sum(1 + id % 3) + 1e-6), 4) as vy from vel group by user_id, lane")
def track_velocity_weighted(spark: SparkSession, d: str) -> DataFrame:
    w = 1 + F.col("id") % 3
    mean = lambda c: F.sum(F.col(c) * w) / (F.sum(w) + 1e-6)
    return _velocity(spark, d).groupBy("user_id", "lane").agg(r4(mean("dx"), "vx"), r4(mean("dy"), "vy"))


_REL = _VEL + ", rel as (select f.user_id, f.t, f.dx - b.dx as rx, f.dy - b.dy as ry from vel f join vel b on f.user_id = b.user_id and f.t = b.t and f.lane = 0 and b.lane = 1)"


def _relative(spark: SparkSession, d: str) -> DataFrame:
    """Foreground less background velocity of each step."""
    vel = _velocity(spark, d)
    b = vel.where("lane = 1").select("user_id", "t", F.col("dx").alias("bx"), F.col("dy").alias("by"))
    return vel.where("lane = 0").join(b, ["user_id", "t"]).select("user_id", "t", (F.col("dx") - F.col("bx")).alias("rx"), (F.col("dy") - F.col("by")).alias("ry"))


@query(_REL + " select user_id, count(*) as n, round(avg(sqrt(rx * rx + ry * ry)), 4) as speed, round(median(sqrt(rx * rx + ry * ry)), 4) as median_speed from rel group by user_id")
def relative_motion_series(spark: SparkSession, d: str) -> DataFrame:
    speed = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))
    return _relative(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), r4(F.avg(speed), "speed"), r4(F.median(speed), "median_speed"))


_HOF = _VEL + f""", b as (select user_id, lane, least(floor((atan2(dy, dx) + pi()) / (2 * pi() / {BINS})), {BINS - 1})::int as bin from vel
), h as (select user_id, lane, bin, count(*) as n from b group by all)"""


def _hof(spark: SparkSession, d: str) -> DataFrame:
    """(user, lane, h): direction histograms as dense arrays; the last bin is closed."""
    bin_ = F.least(F.floor((F.atan2("dy", "dx") + F.pi()) / (2 * F.pi() / BINS)), F.lit(BINS - 1)).cast("int")
    b = _velocity(spark, d).select("user_id", "lane", bin_.alias("bin"))
    return b.groupBy("user_id", "lane").agg(F.array(*(F.count_if(F.col("bin") == k).cast("double") for k in range(BINS))).alias("h"))


@query(_HOF + " select user_id, lane, bin, round(n / sum(n) over (partition by user_id, lane), 4) as share from h")
def hof_histogram(spark: SparkSession, d: str) -> DataFrame:
    out = _hof(spark, d).select("user_id", "lane", F.posexplode(se.unit(F.col("h"))).alias("bin", "x"))
    return out.where("x > 0").select("user_id", "lane", "bin", r4(F.col("x"), "share"))


_DENSE = _HOF + f""", u as (select distinct user_id from vel), grid as (select user_id, lane, bin from u cross join (values (0), (1)) l(lane) cross join (select unnest(range({BINS})) as bin)
), dense as (select g.user_id, g.lane, g.bin, coalesce(h.n, 0) / sum(coalesce(h.n, 0)) over (partition by g.user_id, g.lane) as x from grid g left join h using (user_id, lane, bin)
), two as (select user_id, lane from vel group by all), ok as (select user_id from two group by user_id having count(*) = 2)"""


def _both(spark: SparkSession, d: str) -> DataFrame:
    h = _hof(spark, d)
    one = lambda k, n: h.where(F.col("lane") == k).select("user_id", F.col("h").alias(n))
    return one(0, "a").join(one(1, "b"), "user_id").select("user_id", se.unit(F.col("a")).alias("a"), se.unit(F.col("b")).alias("b"))


@query(_DENSE + f""", rot as (select a.user_id, k.k, a.bin, a.x as xa, b.x as xb from dense a join ok using (user_id) cross join (select unnest(range({BINS})) as k) k join dense b on b.user_id = a.user_id and a.lane = 0 and b.lane = 1 and b.bin = (a.bin + k.k) % {BINS}
), c as (select user_id, k, bin, sum(xa - xb) over (partition by user_id, k order by bin) as diff from rot), s as (select user_id, k, sum(abs(diff)) as emd from c group by user_id, k)
select user_id, round(min(emd), 7) as d_dir, round(min(emd) filter (where k = 0), 7) as cdf_l1, round(100 * exp(-4 * min(emd)), 3) as s_dir from s group by user_id""")
def circular_emd(spark: SparkSession, d: str) -> DataFrame:
    out = _both(spark, d).select("user_id", se.circular_emd(F.col("a"), F.col("b"), BINS).alias("x"), se.cdf_l1(F.col("a"), F.col("b")).alias("y"))
    return out.select("user_id", F.round("x", 7).alias("d_dir"), F.round("y", 7).alias("cdf_l1"), F.round(se.exp_score(F.col("x"), 4.0), 3).alias("s_dir"))


_PHI = _REL + """, dif as (select user_id, t, rx - lag(rx) over w as ax, ry - lag(ry) over w as ay from rel window w as (partition by user_id order by t)
), dd as (select *, ax - lag(ax) over w as jx, ay - lag(ay) over w as jy from dif window w as (partition by user_id order by t)
), phi as (select user_id, avg(ax * ax + ay * ay) as e1, avg(jx * jx + jy * jy) as e2, count(*) as n from dd group by user_id)"""


@query(_PHI + " select user_id, case when n < 3 then 0 else round(e1, 3) end as e1, case when n < 3 then 0 else round(e2, 3) end as e2, case when n < 3 then 0 else round(e2 / (e1 + 1e-8), 4) end as ratio from phi")
def smoothness_phi(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared first and second differences; series shorter than 3 are all zero."""
    w = Window.partitionBy("user_id").orderBy("t")
    diff = lambda c: F.col(c) - F.lag(c).over(w)
    dd = _relative(spark, d).withColumns({"ax": diff("rx"), "ay": diff("ry")}).withColumns({"jx": diff("ax"), "jy": diff("ay")})
    sq = lambda x, y: F.avg(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    phi = dd.groupBy("user_id").agg(sq("ax", "ay").alias("e1"), sq("jx", "jy").alias("e2"), F.count("*").alias("n"))
    long = lambda c, digits, name: F.when(F.col("n") < 3, 0.0).otherwise(F.round(c, digits)).alias(name)
    return phi.select("user_id", long(F.col("e1"), 3, "e1"), long(F.col("e2"), 3, "e2"), long(F.col("e2") / (F.col("e1") + 1e-8), 4, "ratio"))


@query(""", v as (select user_id, list_sort(list(value) filter (where lane = 0)) as a, list_sort(list(value) filter (where lane = 1)) as b from iv group by user_id
), k as (select *, greatest(len(a), len(b)) as n, unnest(range(0, greatest(len(a), len(b)))) as i from v where len(a) > 0 and len(b) > 0
), p as (select *, case when n > 1 then i / (n - 1) else 0 end as p from k
), q as (select *, p * (len(a) - 1) as ta, p * (len(b) - 1) as tb from p
), z as (select user_id, n, a[floor(ta)::int + 1] + (a[least(floor(ta)::int + 1, len(a) - 1)::int + 1] - a[floor(ta)::int + 1]) * (ta - floor(ta)) as qa, b[floor(tb)::int + 1] + (b[least(floor(tb)::int + 1, len(b) - 1)::int + 1] - b[floor(tb)::int + 1]) * (tb - floor(tb)) as qb from q)
select user_id, round(sum(abs(qa - qb)) / any_value(n), 4) as d_mag from z group by user_id""")
def quantile_w1(spark: SparkSession, d: str) -> DataFrame:
    values = lambda k: F.array_sort(F.collect_list(F.when(F.col("lane") == k, F.col("value"))))  # noqa: E731  one clip's series
    v = intervals(spark, d).groupBy("user_id").agg(values(0).alias("a"), values(1).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    return v.select("user_id", r4(se.quantile_w1(F.col("a"), F.col("b")), "d_mag"))


#: Track stand-in: four users are a clip and each a point; ids tell side (reference, generated) and lane (foreground, background).
_TRACKS = """
with tr as (
  select user_id // 4 as clip, (event_id // 2) % 2 as side, event_id % 2 as lane, user_id % 4 as pt, event_type <> 'error' as vis, value / 100.0 as wtex,
         row_number() over (partition by user_id, (event_id // 2) % 2, event_id % 2 order by ts, event_id) as t, value / 100.0 as x, ((event_id * 37) % 100) / 100.0 as y from events
), st as (
  select *, x - lag(x) over w as dx, y - lag(y) over w as dy, lag(vis) over w as pv, lag(t) over w as t0 from tr window w as (partition by clip, side, lane, pt order by t)
), sw as (select *, case when vis and pv then greatest(0, least(1, wtex)) else 0 end as w from st where t0 is not null
), vel as (select clip, side, lane, t, sum(dx * w) / (sum(w) + 1e-6) as vx, sum(dy * w) / (sum(w) + 1e-6) as vy from sw group by all
), rel as (select f.clip, f.side, f.t, f.vx - b.vx as rx, f.vy - b.vy as ry from vel f join vel b on f.clip = b.clip and f.side = b.side and f.t = b.t and f.lane = 0 and b.lane = 1
), spd as (select *, sqrt(rx * rx + ry * ry) as speed from rel)
"""
_FEATURES = _TRACKS + f""", d1 as (select *, rx - lag(rx) over w as ax, ry - lag(ry) over w as ay from spd window w as (partition by clip, side order by t)
), d2 as (
  select *, ax - lag(ax) over w as jx, ay - lag(ay) over w as jy,
         least(floor((case when rx = 0 and ry = 0 then 0 else atan2(ry, rx) end + pi()) / (2 * pi() / {BINS})), {BINS - 1})::int as bin from d1 window w as (partition by clip, side order by t)
), fe as (
  select clip, side, count(*) as n, [{", ".join(f"count(*) filter (where bin = {k})" for k in range(BINS))}]::double[] as h, list_sort(list(speed)) as s,
         case when count(*) < 3 then 0 else avg(ax * ax + ay * ay) end as e1, case when count(*) < 3 then 0 else avg(jx * jx + jy * jy) end as e2 from d2 group by clip, side
), fv as (select clip, side, n, list_transform(h, lambda x: x / n) as h, s, [e1, e2, e2 / (e1 + 1e-8)] as phi from fe
), sh as (
  select *, case when list_sum(phi) > 0 then list_transform(phi, lambda x: x / (list_sum(phi) + 1e-8)) else list_transform(phi, lambda x: 1 / (3 + 1e-8)) end as share from fv
), two as (select a.clip, a.h as ha, b.h as hb, a.s as a, b.s as b, a.share as pa, b.share as pb from sh a join sh b on a.clip = b.clip and a.side = 0 and b.side = 1
), dist as (
  select clip, list_min(list_transform(range(0, {BINS}), lambda k: list_sum(list_transform(range(1, {BINS} + 1), lambda i: abs(list_sum(list_transform(range(0, i), lambda j: ha[j + 1] - hb[(j + k) % {BINS} + 1]))))))) as d_dir,
         (abs(pa[1] - pb[1]) + abs(pa[2] - pb[2]) + abs(pa[3] - pb[3])) / 3 as d_smo from two
), k as (select clip, a, b, greatest(len(a), len(b)) as n, unnest(range(0, greatest(len(a), len(b)))) as i from two
), q as (select *, (case when n > 1 then i / (n - 1) else 0 end) * (len(a) - 1) as ta, (case when n > 1 then i / (n - 1) else 0 end) * (len(b) - 1) as tb from k
), z as (
  select clip, n, a[floor(ta)::int + 1] + (a[least(floor(ta)::int + 1, len(a) - 1)::int + 1] - a[floor(ta)::int + 1]) * (ta - floor(ta)) as qa,
         b[floor(tb)::int + 1] + (b[least(floor(tb)::int + 1, len(b) - 1)::int + 1] - b[floor(tb)::int + 1]) * (tb - floor(tb)) as qb from q
), mag as (select clip, sum(abs(qa - qb)) / any_value(n) as d_mag from z group by clip)
"""
#: Frames of four patches of 16 pixels: 16 vectors in a row are a clip.
_PATCHES = """, fr as (select vec_id // 16 as clip, vec_id % 16 as t, embedding::double[] as px, lag(embedding::double[]) over (partition by vec_id // 16 order by vec_id) as before from embeddings
), pa as (select clip, t, p, px[16 * p + 1:16 * p + 16] as b, before[16 * p + 1:16 * p + 16] as a from (select *, unnest(range(0, 4)) as p from fr where before is not null)
), ce as (select clip, t, p, list_transform(a, lambda x: x - list_avg(a)) as a, list_transform(b, lambda x: x - list_avg(b)) as b from pa
), ncc as (select clip, t, p, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-6) as ncc from ce
), uq as (select clip, t, avg((ncc < 0)::int) as u from ncc group by clip, t
), rf as (select clip, avg((u < 0.5)::int) as rf, avg(u) as uniq_mean, min(u) as uniq_min, max(u) as uniq_max from uq group by clip)
"""
_FREEZE = _PATCHES + """, m as (select clip, median(speed) filter (where side = 0) as mr, quantile_cont(speed, 0.2) filter (where side = 0) as tau from spd group by clip
), ls as (select s.clip, any_value(mr) as mr, any_value(tau) as tau, avg((speed <= tau)::int) as ls from spd s join m on s.clip = m.clip where side = 1 group by s.clip
), frz as (select ls.*, rf, uniq_mean, case when mr <= 0.1 then 0 else greatest(0, least(1, 0.7 * rf + 0.3 * ls)) end as frz from ls join rf using (clip))
"""


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    side, lane = F.expr("(event_id div 2) % 2"), F.col("event_id") % 2
    t = F.row_number().over(Window.partitionBy("user_id", side, lane).orderBy("ts", "event_id"))
    return table(spark, d, "events").select(
        F.expr("user_id div 4").alias("clip"), F.when(side == 0, "ref").otherwise("gen").alias("side"), F.when(lane == 0, "fg").otherwise("bg").alias("lane"), (F.col("user_id") % 4).alias("pt"), t.alias("t"),
        (F.col("value") / 100.0).alias("x"), (((F.col("event_id") * 37) % 100) / 100.0).alias("y"), (F.col("event_type") != "error").alias("vis"), (F.col("value") / 100.0).alias("wtex"),
    )


def _relative_tracks(spark: SparkSession, d: str) -> DataFrame:
    return mo.relative(mo.velocities(_tracks(spark, d)))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.expr("vec_id div 16").alias("clip"), (F.col("vec_id") % 16).alias("t"), F.col("embedding").cast("array<double>").alias("pixels"))


def _frozen(spark: SparkSession, d: str) -> DataFrame:
    rel = _relative_tracks(spark, d)
    ls = mo.low_speed(rel.select("clip", "side", F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry")).alias("speed")))
    rf = mo.frozen_frames(mo.patch_similarity(_frames(spark, d), patch=16), unlike=0.0, least=0.5)
    return ls.join(rf, "clip").withColumn("frz", mo.freeze(F.col("rf"), F.col("ls"), F.col("median_ref")))


@query(_TRACKS + _PATCHES + " select clip, t, p, round(ncc, 4) as ncc from ncc")
def patch_ncc(spark: SparkSession, d: str) -> DataFrame:
    return mo.patch_similarity(_frames(spark, d), patch=16).select("clip", "t", "p", r4(F.col("ncc"), "ncc"))


@query(_TRACKS + _PATCHES + " select clip, round(rf, 4) as rf, round(uniq_mean, 4) as uniq_mean, uniq_min, uniq_max from rf")
def repeat_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = mo.frozen_frames(mo.patch_similarity(_frames(spark, d), patch=16), unlike=0.0, least=0.5)
    return out.select("clip", r4(F.col("rf"), "rf"), r4(F.col("uniq_mean"), "uniq_mean"), "uniq_min", "uniq_max")


@query(_TRACKS + _FREEZE + " select clip, round(mr, 4) as median_ref, round(tau, 4) as tau, round(ls, 4) as ls, round(rf, 4) as rf, round(frz, 4) as frz from frz")
def freeze_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Frames that hardly change by their patches, and generated speeds under the reference's fifth, gated by the reference's median speed."""
    return _frozen(spark, d).select("clip", *(r4(F.col(c), c) for c in ("median_ref", "tau", "ls", "rf", "frz")))


@query(_FEATURES + " select clip, side::int as side, n, round(phi[1], 5) as e1, round(phi[2], 5) as e2, round(phi[3], 3) as ratio, round(s[1], 5) as slowest, round(s[len(s)], 5) as fastest from fv")
def motion_features(spark: SparkSession, d: str) -> DataFrame:
    f = mo.features(_relative_tracks(spark, d), bins=BINS)
    phi = [F.round(F.get("phi", F.lit(k)), n).alias(c) for k, n, c in ((0, 5, "e1"), (1, 5, "e2"), (2, 3, "ratio"))]
    return f.select("clip", F.when(F.col("side") == "ref", 0).otherwise(1).alias("side"), "n", *phi, F.round(F.array_min("s"), 5).alias("slowest"), F.round(F.array_max("s"), 5).alias("fastest"))


@query(_FEATURES + " select clip, round(d_dir, 5) as d_dir, round(d_mag, 5) as d_mag, round(d_smo, 5) as d_smo from dist join mag using (clip)")
def motion_distances(spark: SparkSession, d: str) -> DataFrame:
    out = mo.distances(mo.features(_relative_tracks(spark, d), bins=BINS), bins=BINS)
    return out.select("clip", *(F.round(c, 5).alias(c) for c in ("d_dir", "d_mag", "d_smo")))


@query(_FEATURES + _FREEZE + """, sc as (select clip, 45 * exp(-4 * d_dir) + 40 * exp(-d_mag) + 15 * exp(-2 * d_smo) as s from dist join mag using (clip))
select clip, round(s, 3) as s_motion, round(s * (1 - 0.1 * coalesce(frz, 0)), 3) as s_motion_w_frz from sc left join frz using (clip)""")
def motion_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of the three distances, and the same less the freeze penalty where a clip has frames."""
    dist = mo.distances(mo.features(_relative_tracks(spark, d), bins=BINS), bins=BINS)
    s = dist.select("clip", mo.score(F.col("d_dir"), F.col("d_mag"), F.col("d_smo")).alias("s")).join(_frozen(spark, d).select("clip", "frz"), "clip", "left")
    return s.select("clip", F.round("s", 3).alias("s_motion"), F.round(F.col("s") * (1 - 0.1 * F.coalesce("frz", F.lit(0.0))), 3).alias("s_motion_w_frz"))


@query("select user_id as clip, round(median(value / 100), 4) as coverage from events group by user_id having median(value / 100) >= 0.45")
def coverage_median_gate(spark: SparkSession, d: str) -> DataFrame:
    masks = table(spark, d, "events").select(F.col("user_id").alias("clip"), (F.col("value") / 100).alias("coverage"))
    return mo.covered(masks, least=0.45).select("clip", r4(F.col("coverage"), "coverage"))


@query("""with p as (select user_id, user_id % 10 as t0, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value from events)
select user_id // 4 as clip, t0 + i as t, count(*) as n, round(sum(value), 3) as total from p group by 1, 2""")
def tracks_on_timeline(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    p = table(spark, d, "events").select(F.expr("user_id div 4").alias("clip"), (F.col("user_id") % 10).alias("t0"), i.alias("i"), "value")
    return mo.on_timeline(p).groupBy("clip", "t").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("select event_type, round(quantile_cont(nullif(value, 0.01), 0.95), 4) as p95, count(*) filter (where value > 100) as high from events group by event_type")
def p95_nan_safe(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.isnan("value"), None).otherwise(F.nullif("value", F.lit(0.01)))
    ev = table(spark, d, "events").select("event_type", "value", value.alias("v"))
    p95 = quantiles.exact_quantiles(ev, "event_type", "v", [0.95], limit=1_000).select(F.col("key").alias("event_type"), r4(F.col("quantile"), "p95"))
    high = ev.groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("high"))
    return high.join(p95, "event_type", "left").select("event_type", "p95", "high")
