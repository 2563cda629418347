"""One job from folders of event files to the board: read, pair, gate, match, score, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import vectors as v
from ..operators import assign, events
from ..streaming.jobs import place_of
from .readers import read_events, unit_vectors
from .writers import append_scores, write_boards

#: Weights of meaning and time in a pair's quality, and what a candidate needs of each.
MEANING, TIME, LEAST_MEANING, LEAST_TIME = 0.8, 0.2, 0.8, 0.5
SCORES = ["ega", "erel", "ecr", "s_event"]


def _events(spark: SparkSession, path: str) -> DataFrame:
    """(name, id, times as shares and in seconds, unit vector) of event files; events without times are left out."""
    x = unit_vectors(read_events(spark, path)).where("s is not null and e is not null")
    return x.select(F.col("sample_id").alias("name"), "id", F.col("s").alias("share_s"), F.col("e").alias("share_e"), F.coalesce("s_abs", "s").alias("s"), F.coalesce("e_abs", "e").alias("e"), "emb")


def score_events(spark: SparkSession, refs: str, gens: str, *, delta: float = 1e-6) -> DataFrame:
    """(modelname, sample_id, ega, erel, ecr, s_event) of every generated clip whose sample has reference events.

    Reference files are ``<sample>.events.json``, generated ones ``<sample>__<model>.events.json``, merged or not. Candidates are like enough in meaning, (cos + 1) / 2, and in
    time, by the relaxed IoU of their shares of the clip; an event without a vector is like none. Of the gated candidates as many as can be
    are matched, the best of such choices; quality, relations and coverage of the matches make the total.
    """
    ref = _events(spark, refs).withColumnRenamed("name", "sample_id")
    named = _events(spark, gens).where(F.col("name").contains("__"))
    gen = named.withColumns({"sample_id": F.split_part("name", F.lit("__"), F.lit(1)), "modelname": F.split_part("name", F.lit("__"), F.lit(2))}).drop("name")
    pairs = gen.select("modelname", "sample_id").distinct().join(ref.select("sample_id").distinct(), "sample_id", "left_semi")
    at = place_of(spark, "event-pairs")
    pairs.withColumn("key", F.monotonically_increasing_id()).write.parquet(at)  # numbers that stay as they are
    pairs = spark.read.parquet(at)
    number = F.row_number().over(Window.partitionBy("key").orderBy("s", "e", "id")).cast("long")  # of one clip
    both = ref.join(pairs.select("sample_id", "key"), "sample_id").withColumn("n", number), gen.join(pairs, ["modelname", "sample_id"]).withColumn("n", number)
    side = lambda t, c: t.select("key", F.col("n").alias(f"{c}_id"), *(F.col(x).alias(f"{c}_{x}") for x in ("share_s", "share_e", "emb")))
    met = side(both[0], "ref").join(side(both[1], "gen"), "key")
    alike = v.similarity01(v.dot(v.as_double(F.col("ref_emb")), v.as_double(F.col("gen_emb"))))
    time = iv.hull_iou(F.col("ref_share_s"), F.col("ref_share_e"), F.col("gen_share_s"), F.col("gen_share_e"), delta)
    met = met.withColumns({"_alike": alike, "_time": time})
    gated = (F.col("_alike") >= LEAST_MEANING) & (F.col("_time") >= LEAST_TIME)
    cand = met.select("key", "ref_id", "gen_id", (MEANING * F.col("_alike") + TIME * F.col("_time")).alias("score"), gated.alias("gated"))
    matches = assign.match(cand, mode="event").withColumnRenamed("score", "q")
    spans = lambda t: t.select("key", F.col("n").alias("id"), "s", "e")
    return events.event_scores(matches, spans(both[0]), spans(both[1])).join(pairs, "key").select("modelname", "sample_id", *SCORES)


def run_event_board(spark: SparkSession, refs: str, gens: str, out: str) -> DataFrame:
    """Score all pairs, append them under ``<out>/scores`` by model, and write the wide table and the models' averages under ``<out>``; the scores are returned as written."""
    at = place_of(spark, "event-scores")
    score_events(spark, refs, gens).write.parquet(at)
    scores = spark.read.parquet(at)
    append_scores(scores, f"{out}/scores", SCORES)
    write_boards(scores, out, SCORES)
    return scores
