"""What a board shows: leaderboards by a dimension, a model's scores, samples and statistics of themes and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import label_of

DIMENSIONS = ("semantic_score", "motion_score", "event_score", "world_score")
STATES = ("pending", "processing", "completed", "failed")


def in_hundredths(world: Column) -> Column:
    """A world band of 1 to 5 as 20 to 100; what is larger already is left."""
    return F.when(world <= 5, world * 20).otherwise(world)


def model_scores(merged: DataFrame) -> DataFrame:
    """(modelname, samples, four means over what there is, total_score): the plain mean of the four, of which none may be missing."""
    mean = merged.groupBy("modelname").agg(F.count("sample_id").alias("samples"), *(F.avg(c).alias(c) for c in DIMENSIONS))
    mean = mean.withColumn("world_score", in_hundredths(F.col("world_score")))
    return mean.withColumn("total_score", sum(F.col(c) for c in DIMENSIONS) / len(DIMENSIONS))


def leaderboard(models: DataFrame, dimension: str = "total_score") -> DataFrame:
    """Models with a score of ``dimension``, best first, with their rank; equal ones by name. A row per model, so that one window is enough."""
    w = Window.orderBy(F.desc(dimension), "modelname")
    return models.where(F.col(dimension).isNotNull()).withColumn("rank", F.row_number().over(w)).orderBy("rank")


def samples_of(refs: DataFrame, theme: str | None = None, shot_type: str | None = None) -> DataFrame:
    """References of a theme and a kind of shot, with the names that a board shows, newest first."""
    out = refs.where(F.col("theme") == theme) if theme else refs
    out = out.where(F.col("shot_type") == shot_type) if shot_type else out
    return out.withColumns({"theme_display": label_of(F.col("theme")), "shot_display": label_of(F.col("shot_type"))}).orderBy(F.desc("created_at"), "video_id")


def theme_statistics(refs: DataFrame) -> DataFrame:
    """(theme, n) of each theme, and of all under null."""
    return refs.rollup("theme").agg(F.count("*").alias("n"), F.grouping("theme").alias("_all")).where("_all = 1 or theme is not null").drop("_all")


def task_statistics(tasks: DataFrame) -> DataFrame:
    """One row: total, and the number in each state."""
    return tasks.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATES))


