"""Motion features of clips and their distances: weighted velocities, relative motion, histograms, energies, freeze penalty.

Tracks are rows (clip, side, lane, pt, t, x, y, vis, wtex); ``side`` is ref or gen, ``lane`` fg or bg. Windows and groups are those of one
clip's side, whose frames are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as se

SIDE = ["clip", "side"]


def velocities(tracks: DataFrame) -> DataFrame:
    """(clip, side, lane, t, vx, vy): mean displacement of the points seen at t - 1 and t, weighted by their texture."""
    w = Window.partitionBy(*SIDE, "lane", "pt").orderBy("t")
    seen = F.coalesce(F.col("vis"), F.lit(False)) & F.coalesce(F.lag("vis").over(w), F.lit(False)) & (F.lag("t").over(w) == F.col("t") - 1)
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("wtex")))
    step = tracks.select(*SIDE, "lane", "t", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"), F.when(seen, weight).otherwise(0.0).alias("w"), F.lag("t").over(w).alias("_before"))
    mean = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("w")) / (F.sum("w") + 1e-6)
    return step.where("_before is not null").groupBy(*SIDE, "lane", "t").agg(mean("dx").alias("vx"), mean("dy").alias("vy"))


def relative(vel: DataFrame) -> DataFrame:
    """(clip, side, t, rx, ry): foreground less background velocity."""
    back = vel.where("lane = 'bg'").select(*SIDE, "t", F.col("vx").alias("bx"), F.col("vy").alias("by"))
    both = vel.where("lane = 'fg'").join(back, [*SIDE, "t"])
    return both.select(*SIDE, "t", (F.col("vx") - F.col("bx")).alias("rx"), (F.col("vy") - F.col("by")).alias("ry"))


def features(rel: DataFrame, *, bins: int = 8) -> DataFrame:
    """(clip, side, hof, s, phi, n): direction histogram, sorted finite speeds, and [e1, e2, ratio]; zero motion counts in the bin of angle 0."""
    angle = F.when((F.col("rx") == 0) & (F.col("ry") == 0), 0.0).otherwise(F.atan2("ry", "rx"))
    bin_ = F.least(F.floor((angle + F.pi()) / (2 * F.pi() / bins)), F.lit(bins - 1)).cast("int")
    w = Window.partitionBy(*SIDE).orderBy("t")
    diff = lambda c: F.col(c) - F.lag(c).over(w)
    d = rel.withColumns({"ax": diff("rx"), "ay": diff("ry")}).withColumns({"jx": diff("ax"), "jy": diff("ay")})
    d = d.withColumns({"bin": bin_, "speed": F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))})
    square = lambda a, b: F.avg(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    finite = F.when(~F.isnan("speed") & (F.col("speed") < float("inf")), F.col("speed"))
    out = d.groupBy(*SIDE).agg(
        F.array(*(F.count_if(F.col("bin") == k).cast("double") for k in range(bins))).alias("hof"), F.array_sort(F.collect_list(finite)).alias("s"),
        F.count("*").alias("n"), square("ax", "ay").alias("e1"), square("jx", "jy").alias("e2"),
    )
    e1, e2 = (F.when(F.col("n") < 3, 0.0).otherwise(F.col(c)) for c in ("e1", "e2"))
    return out.select(*SIDE, "hof", "s", F.array(e1, e2, e2 / (e1 + 1e-8)).alias("phi"), "n")


def distances(feats: DataFrame, *, bins: int = 8) -> DataFrame:
    """(clip, d_dir, d_mag, d_smo) of the clips that have both sides."""
    side = lambda s, c: feats.where(F.col("side") == s).select("clip", *(F.col(x).alias(f"{c}_{x}") for x in ("hof", "s", "phi")))
    both = side("ref", "a").join(side("gen", "b"), "clip")
    empty = (F.size("a_s") == 0) | (F.size("b_s") == 0)
    return both.select(
        "clip", se.circular_emd(se.unit(F.col("a_hof")), se.unit(F.col("b_hof")), bins).alias("d_dir"),
        F.when(empty, 0.0).otherwise(se.quantile_w1(F.col("a_s"), F.col("b_s"))).alias("d_mag"), se.l1_shares(F.col("a_phi"), F.col("b_phi")).alias("d_smo"),
    )


def score(d_dir: Column, d_mag: Column, d_smo: Column, *, rates=(4.0, 1.0, 2.0), shares=(0.45, 0.40, 0.15)) -> Column:
    return sum(w * se.exp_score(d, r) for d, r, w in zip((d_dir, d_mag, d_smo), rates, shares, strict=True))


def patch_similarity(frames: DataFrame, *, patch: int, eps: float = 1e-6) -> DataFrame:
    """(clip, t, p, ncc) of each patch with the same patch of the frame before; frames are (clip, t, pixels), patches runs of ``patch`` pixels.

    Zero-mean normalised correlation with ``eps`` added to its divisor.
    """
    w = Window.partitionBy("clip").orderBy("t")
    pair = frames.withColumn("before", F.lag("pixels").over(w)).where("before is not null")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size("pixels") / patch).cast("int") - 1), lambda k: F.struct(k.alias("p"), F.slice("pixels", k * patch + 1, patch).alias("b"), F.slice("before", k * patch + 1, patch).alias("a")))
    flat = pair.select("clip", "t", F.inline(parts))
    centred = lambda x: F.transform(x, lambda y: y - se.total(x) / F.size(x))
    flat = flat.select("clip", "t", "p", centred(F.col("a")).alias("a"), centred(F.col("b")).alias("b"))
    dot = lambda x, y: se.total(F.zip_with(x, y, lambda i, j: i * j))
    a, b = F.col("a"), F.col("b")
    return flat.select("clip", "t", "p", (dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + eps)).alias("ncc"))


def frozen_frames(patches: DataFrame, *, unlike: float = 0.9, least: float = 0.15) -> DataFrame:
    """(clip, rf, uniq_mean, uniq_min, uniq_max): share of frames of whose patches too few have changed."""
    frame = patches.groupBy("clip", "t").agg(F.avg(F.when(F.col("ncc") < unlike, 1.0).otherwise(0.0)).alias("u"))
    return frame.groupBy("clip").agg(F.avg(F.when(F.col("u") < least, 1.0).otherwise(0.0)).alias("rf"), F.avg("u").alias("uniq_mean"), F.min("u").alias("uniq_min"), F.max("u").alias("uniq_max"))


def low_speed(speeds: DataFrame, *, quantile: float = 0.2) -> DataFrame:
    """(clip, median_ref, tau, ls): share of generated speeds no higher than the reference's ``quantile``; speeds are (clip, side, speed)."""
    ref = F.when(F.col("side") == "ref", F.col("speed"))
    m = speeds.groupBy("clip").agg(F.median(ref).alias("median_ref"), F.percentile(ref, F.lit(quantile)).alias("tau"))
    gen = speeds.where("side = 'gen'").join(m, "clip")
    return gen.groupBy("clip").agg(F.first("median_ref").alias("median_ref"), F.first("tau").alias("tau"), F.avg(F.when(F.col("speed") <= F.col("tau"), 1.0).otherwise(0.0)).alias("ls"))


def freeze(rf: Column, ls: Column, median_ref: Column, *, tau_motion: float = 0.1, w_rf: float = 0.7, w_ls: float = 0.3) -> Column:
    """Penalty 0 to 1; none where the reference itself hardly moves."""
    return F.when(median_ref <= tau_motion, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w_rf * rf + w_ls * ls)))


def covered(masks: DataFrame, *, least: float) -> DataFrame:
    """Clips whose median mask coverage reaches ``least``; masks are (clip, coverage), a row per frame."""
    return masks.groupBy("clip").agg(F.median("coverage").alias("coverage")).where(F.col("coverage") >= least)


def on_timeline(tracks: DataFrame) -> DataFrame:
    """Partial tracks (clip, pt, t0, i, ..) on the clip's own timeline: t = t0 + i."""
    return tracks.withColumn("t", F.col("t0") + F.col("i"))
