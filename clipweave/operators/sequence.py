"""Sequences of a clip: scenes, segments between boundaries, clipped and overlapping windows, joins by id or position, state logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scenes(transitions: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, s, e) in seconds from cuts (clip, t) in frames and clips (clip, n_frames, fps): from each cut to the next, first and last included.

    Cuts outside the clip and repeated ones count for nothing; a clip without frames has no scenes, one without cuts is one scene.
    """
    inside = transitions.join(clips, "clip").where("t >= 0 and t < n_frames").select("clip", "t").distinct()
    live = clips.where("n_frames > 0")
    cuts = inside.withColumn("o", F.lit(1)).union(live.select("clip", F.lit(0).alias("t"), F.lit(0).alias("o"))).union(live.select("clip", F.col("n_frames").alias("t"), F.lit(2).alias("o")))
    w = Window.partitionBy("clip").orderBy("t", "o")
    spans = cuts.withColumn("e", F.lead("t").over(w)).where("e is not null").join(clips.select("clip", "fps"), "clip")
    return spans.select("clip", (F.col("t") / F.col("fps")).alias("s"), (F.col("e") / F.col("fps")).alias("e"))


def segments_between(bounds: DataFrame, clips: DataFrame, *, least: float) -> DataFrame:
    """(clip, s, e) between boundaries (clip, at), held to the clip (clip, t0, t1), with its first and last part, none shorter than ``least``."""
    held = bounds.join(clips, "clip").select("clip", F.greatest("t0", F.least("t1", "at")).alias("s"))
    ends = clips.select("clip", F.explode(F.array("t0", "t1")).alias("s"))
    w = Window.partitionBy("clip").orderBy("s")
    cut = held.union(ends).distinct().withColumn("e", F.lead("s").over(w))
    return cut.where(F.col("e") - F.col("s") >= least)


def clip_windows(clips: DataFrame, *, size: float = 6.0, hop: float = 3.0) -> DataFrame:
    """(clip, k, s, e): windows of ``size`` every ``hop`` seconds of clips (clip, dur), the last one cut at the end; none begins after one that reaches it."""
    last = F.when(F.col("dur") > 0, F.greatest(F.lit(0), F.ceil((F.col("dur") - size) / hop))).otherwise(0).cast("int")
    k = clips.select("clip", "dur", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return k.select("clip", "k", (F.col("k") * hop).alias("s"), F.least("dur", F.col("k") * hop + size).alias("e"))


def overlap_average(frames: DataFrame, score: Column, *, size: int = 100, stride: int = 50) -> DataFrame:
    """(clip, t, score): every frame's mean ``score`` over the windows of ``size`` frames, begun every ``stride``, that it is in.

    Frames are (clip, t, ..) from 0. ``score`` may use ``win`` and window functions over (clip, win).
    """
    first = F.greatest(F.lit(0), F.floor((F.col("t") - size) / stride) + 1)
    each = frames.withColumn("win", F.explode(F.sequence(first.cast("long"), F.floor(F.col("t") / stride).cast("long"))))
    return each.withColumn("_y", score).groupBy("clip", "t").agg(F.avg("_y").alias("score"))


def align(times: DataFrame, texts: DataFrame) -> DataFrame:
    """(clip, time_id, text_id, how): times and texts (clip, id, ord) of equal ids; of clips in which none are equal, by position if there are as many of both."""
    a, b = times.select("clip", F.col("id").alias("time_id"), F.col("ord").alias("ta")), texts.select("clip", F.col("id").alias("text_id"), F.col("ord").alias("tb"))
    by_id = a.join(b, (a["clip"] == b["clip"]) & (F.col("time_id") == F.col("text_id"))).select(a["clip"], "time_id", "text_id", F.lit("id").alias("how"))
    met = by_id.select("clip").distinct()
    place = lambda t, o: t.join(met, "clip", "left_anti").withColumns({"rn": F.row_number().over(Window.partitionBy("clip").orderBy(o)), "n": F.count("*").over(Window.partitionBy("clip"))})
    by_place = place(a, "ta").join(place(b, "tb"), ["clip", "rn", "n"]).select("clip", "time_id", "text_id", F.lit("position").alias("how"))
    return by_id.union(by_place)


# What a task may turn to.
MOVES = (("pending", "processing"), ("processing", "completed"), ("processing", "failed"), ("pending", "failed"))


#: States that a task may stay in too long.
OPEN = ("pending", "processing")


def transitions(log: DataFrame) -> DataFrame:
    """``log`` (task, at, seq, status, ..) with ``before`` and ``legal``: whether the task may turn so; a task begins as pending."""
    w = Window.partitionBy("task").orderBy("at", "seq")
    before = F.lag("status").over(w)
    allowed = F.concat_ws(">", "before", "status").isin(*(f"{a}>{b}" for a, b in MOVES))
    return log.withColumn("before", before).withColumn("legal", F.when(F.col("before").isNull(), F.col("status") == "pending").otherwise(allowed))


def transitions_with_time_outs(log: DataFrame, *, limit: float) -> DataFrame:
    """(task, at, seq, status, before, legal, timed_out) of a log (task, at, seq, status), and a row where a task has stayed open for over ``limit`` seconds.

    A time-out fails the task ``limit`` after its last change, with -1 as ``seq``; what comes later finds it failed.
    """
    w = Window.partitionBy("task").orderBy("at", "seq")
    due = F.col("at") + F.make_interval(secs=F.lit(limit))
    seen = log.select("task", "at", "seq", "status").withColumns({"_before": F.lag("status").over(w), "_due": due, "_next": F.lead("at").over(w)})
    seen = seen.withColumn("_out", F.col("status").isin(*OPEN) & (F.col("_next").isNull() | (F.col("_next") > F.col("_due"))))
    seen = seen.withColumn("before", F.when(F.lag("_out").over(w), "failed").otherwise(F.col("_before")))
    fits = lambda a, b: F.concat_ws(">", a, b).isin(*(f"{x}>{y}" for x, y in MOVES))
    legal = F.when(F.col("before").isNull(), F.col("status") == "pending").otherwise(fits("before", "status"))
    told = seen.select("task", "at", "seq", "status", "before", legal.alias("legal"), F.lit(False).alias("timed_out"))
    failed = F.lit("failed")
    over = seen.where("_out").select("task", F.col("_due").alias("at"), F.lit(-1).cast("long").alias("seq"), failed.alias("status"), F.col("status").alias("before"), fits("status", failed).alias("legal"), F.lit(True).alias("timed_out"))
    return told.unionByName(over)


def encode_once(texts: DataFrame, encode: Column) -> DataFrame:
    """``texts`` (purpose, text, ..) with ``vec``; ``encode``, a column over purpose and text, runs once for every different pair."""
    known = texts.select("purpose", "text").distinct().withColumn("vec", encode)
    return texts.join(known, ["purpose", "text"], "left")
