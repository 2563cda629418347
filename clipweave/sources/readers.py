"""Readers of the evidence formats: JSON arrays of events, score tables with many header names, sample metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import bank_stem, enabled_count, event_list, merged_count
from ..functions.json_walk import kind_of
from ..functions.scores import event_scores, picked_number
from ..functions.text import stem, tolerant_float
from .files import read_csv_any  # noqa: F401

_EVENT = "id:string,eid:string,event_id:string,parent_id:string,s:double,e:double,dur:double,members:array<string>,s_abs:double,e_abs:double,dur_abs:double,text:string,emb:array<float>,embedding:array<float>,vec:array<float>,norm:boolean"
EVENTS = f"array<struct<{_EVENT}>>"
VIDEO_ENDS = ("mp4", "avi", "mov", "mkv", "webm")
# The headers under which score tables carry a column, first non-null first.
HEADERS = {
    "modelname": ("modelname", "model", "模型"),
    "sample_id": ("sample_id", "sample", "name", "名称", "video", "id"),
    "semantic_score": ("s_base", "semantic__s_base", "semanticscore", "semantic_score"),
    "motion_score": ("s_motion_w_frz", "motion__s_motion_w_frz", "motionscore", "motion_score"),
    "event_score": ("s_event", "event__s_event", "eventscore", "event_score", "score"),
    "world_score": ("worldscore", "world_score", "得分", "score", "mapped_score_0_5", "band"),
}


def sample_of(path: Column) -> Column:
    """Sample id of a file: its name without extensions."""
    return F.regexp_replace(stem(path), r"\.(new)?events$", "")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, name, doc, error): a row per JSON file; a broken one has no doc and tells what is wrong, so that it is not
    taken for an empty one. Files of no bytes at all are not read by Spark, and have no row."""
    files = spark.read.format("binaryFile").load(path)
    raw = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("content").cast("string").alias("value"))
    whole = raw.withColumn("_ok", F.try_parse_json("value").isNotNull())
    error = F.when(F.col("value").rlike(r"^\s*$"), "empty file").when(~F.col("_ok"), F.concat(F.lit("not JSON: "), F.left(F.trim("value"), F.lit(80))))
    return whole.select("path", "name", F.when(F.col("_ok"), F.from_json("value", schema)).alias("doc"), error.alias("error"))


def _event_rows(raw: DataFrame) -> DataFrame:
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", EVENTS)).otherwise(F.from_json("value", f"struct<events:{EVENTS}>")["events"])
    x = raw.select(sample_of(F.col("path")).alias("sample_id"), F.explode(listed).alias("x"))
    vec = F.coalesce("x.emb", "x.embedding", "x.vec")
    kept = ("s", "e", "dur", "members", "s_abs", "e_abs", "dur_abs", "text", "norm", "parent_id")
    return x.select("sample_id", F.coalesce("x.id", "x.eid", "x.event_id").alias("id"), *(f"x.{c}" for c in kept), vec.alias("emb"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A row per event of JSON files that hold either an array or ``{"events": [...]}``, ids and vectors under any of their usual names.

    Columns: sample_id and the fields of an event. Files are read whole as text, one row each, and parsed on the executors. Broken files give no
    events; ``broken_files`` names them.
    """
    return _event_rows(spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path")))


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the JSON files that cannot be read."""
    return read_documents(spark, path, "variant").where("error is not null").select("path", "error")


def unit_vectors(events: DataFrame) -> DataFrame:
    """``events`` with ``emb`` of length 1; one without length, or with what is no number, is null."""
    n = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda t, x: t + x * x))
    return events.withColumn("emb", F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform("emb", lambda x: (x / n).cast("float"))))


def are_micro(events: DataFrame) -> DataFrame:
    """(sample_id, micro): whether a sample's vectors are of parts of events, by their parents or the ``#`` in their ids."""
    return events.groupBy("sample_id").agg(F.bool_or(F.col("parent_id").isNotNull() | F.col("id").contains("#")).alias("micro"))


def event_texts(events: DataFrame) -> DataFrame:
    """(sample_id, id, text): of micro events the parent's, its clauses joined by `` | `` in order."""
    parent = F.coalesce("parent_id", F.regexp_replace("id", "#.*$", ""))
    part = F.coalesce(F.regexp_extract("id", "#([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return events.where("text is not null").groupBy("sample_id", parent.alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part.alias("k"), "text"))), lambda x: x["text"]), " | ").alias("text"))


def span_map(events: DataFrame) -> DataFrame:
    """(sample_id, id, s, e): spans in seconds, else as they are, else 0; of repeated ids the first by start."""
    x = events.select("sample_id", "id", F.coalesce("s_abs", "s", F.lit(0.0)).alias("s"), F.coalesce("e_abs", "e", F.lit(0.0)).alias("e")).where("id is not null")
    return x.groupBy("sample_id", "id").agg(F.min(F.struct("s", "e")).alias("x")).select("sample_id", "id", "x.s", "x.e")


def _scene_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, scenes, error): scenes as texts, of ``{"scenes": [[s, e], ...]}`` or of the list alone."""
    d = read_documents(spark, path, "variant")
    listed = F.when(kind_of(F.col("doc")) == "object", F.try_variant_get("doc", "$.scenes", "variant")).otherwise(F.col("doc"))
    scenes = F.when(kind_of(listed) == "array", F.try_variant_get(listed, "$", "array<array<double>>"))
    wrong = F.when(scenes.isNull(), "no list of scenes").when(F.exists(scenes, lambda x: ~_is_pair(x)), "scenes that are no pairs of numbers")
    return d.select("path", scenes.alias("scenes"), F.coalesce("error", wrong).alias("error"))


def _is_pair(x: Column) -> Column:
    return F.coalesce((F.size(x) >= 2) & F.get(x, F.lit(0)).isNotNull() & F.get(x, F.lit(1)).isNotNull(), F.lit(False))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, k, s, e) of scene files, each ``{"scenes": [[s, e], ...]}`` or a list of pairs of seconds. Members that are no pairs give no row;
    ``broken_scenes`` names the files that have such, or no list at all."""
    d = _scene_files(spark, path).where("scenes is not null").select(sample_of(F.col("path")).alias("sample_id"), F.posexplode("scenes").alias("k", "x"))
    return d.where(_is_pair(F.col("x"))).select("sample_id", "k", F.get("x", F.lit(0)).alias("s"), F.get("x", F.lit(1)).alias("e"))


def broken_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of scene files that are no JSON, have no list, or members that are no pairs of numbers."""
    return _scene_files(spark, path).where("error is not null").select("path", "error")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))


def read_event_lists(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, total, enabled): events of each file, under whatever key they lie, and those that are switched on."""
    listed = _texts(spark, path).select(sample_of(F.col("path")).alias("sample_id"), event_list(F.col("value")).alias("x"))
    return listed.select("sample_id", F.size("x").cast("long").alias("total"), enabled_count(F.col("x")).alias("enabled"))


def read_merged_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, ref_merged_events): the number of merged events of each file as text, empty where a file tells none."""
    return _texts(spark, path).select(sample_of(F.col("path")).alias("sample_id"), merged_count(F.col("value")).alias("ref_merged_events"))


def read_event_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, ega, erel, ecr, s_event, erel_valid) of score reports of any layout; those without all four scores are left out."""
    return _texts(spark, path).select("path", event_scores(F.col("value")).alias("x")).where("x is not null").select("path", "x.*")


def fallback_scores(spark: SparkSession, path: str) -> DataFrame:
    """(modelname, sample_id, event_score) of ``scores/<model>/<sample>__<model>/scores.json`` files; those without a number are left out."""
    model = F.trim(F.regexp_extract("path", r"/scores/([^/]+)/(?:.*/)?[^/]+/scores\.json$", 1))
    folder = F.trim(F.split_part(F.regexp_extract("path", r"([^/]+)/scores\.json$", 1), F.lit("__"), F.lit(1)))
    sample = F.regexp_replace(folder, r"(?i)\.(mp4|avi|mov|mkv|webm)$", "")
    out = _texts(spark, path).select(F.url_decode(model).alias("modelname"), F.url_decode(sample).alias("sample_id"), picked_number(F.col("value")).alias("event_score"))
    return out.where("modelname <> '' and sample_id <> '' and event_score is not null")


def read_samples(spark: SparkSession, path: str, themes: list[str] | None = None) -> DataFrame:
    """(sample_id, theme, prompt) of JSON lines; bad lines and those without an id are left out, and themes other than ``themes``."""
    rows = spark.read.schema("sample_id string, id string, topic string, theme string, prompt string").option("mode", "DROPMALFORMED").json(path)
    out = rows.select(F.coalesce("sample_id", "id").alias("sample_id"), F.coalesce("topic", "theme").alias("theme"), "prompt").where("sample_id is not null")
    return out.where(F.col("theme").isin(themes)) if themes is not None else out


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, theme, shot_type, prompt) of ``theme/name_single_001.txt`` files; empty ones are left out."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    name = stem(F.col("path"))
    shot = F.lower(F.regexp_extract(name, r"(?i)_(single|multi)(?:_|$)", 1))
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    return raw.select(name.alias("video_id"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("theme"), F.when(shot == "", "single").otherwise(shot).alias("shot_type"), text.alias("prompt")).where("prompt <> ''")


def video_index(files: DataFrame) -> DataFrame:
    """(stem, path): videos (path) by normalised stem; of several the last path stands."""
    ends = "|".join(VIDEO_ENDS)
    return files.where(F.col("path").rlike(rf"(?i)\.({ends})$")).groupBy(bank_stem(stem(F.col("path"))).alias("stem")).agg(F.max("path").alias("path"))


def bank_index(banks: DataFrame) -> DataFrame:
    """(stem, path): banks (path, video) by the stem of their file's name, else by that of the video they name; the first path stands."""
    of = lambda c, prio: banks.select(bank_stem(stem(F.col(c))).alias("stem"), "path", F.lit(prio).alias("_prio"))
    both = of("path", 0).union(of("video", 1)).where("stem <> ''")
    return both.groupBy("stem").agg(F.min(F.struct("_prio", "path")).alias("x")).select("stem", "x.path")


def _plain(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def read_scores(table: DataFrame, want: tuple[str, ...]) -> DataFrame:
    """modelname, sample_id and the wanted scores of a table whose headers vary; numbers are parsed tolerantly, missing columns are null."""
    have = {_plain(c): c for c in table.columns}
    pick = lambda n: F.coalesce(*(F.col(f"`{have[c]}`").cast("string") for c in HEADERS[n] if c in have), F.lit(None).cast("string"))
    sample = F.regexp_replace(pick("sample_id"), r"(?i)\.(mp4|avi|mov|mkv|webm)$", "")
    return table.select(F.trim(pick("modelname")).alias("modelname"), sample.alias("sample_id"), *(tolerant_float(pick(n)).alias(n) for n in want))


def merge_scores(tables: list[DataFrame], fallback: DataFrame | None = None) -> DataFrame:
    """One row per (modelname, sample_id): for each score the first non-null value in the order of ``tables``.

    ``fallback``, such as ``fallback_scores``, fills what none of the tables has, and adds the samples that only it knows.
    """
    long = None
    for prio, t in enumerate([*tables, *([fallback] if fallback is not None else [])]):
        t = t.withColumn("_prio", F.lit(prio))
        long = t if long is None else long.unionByName(t, allowMissingColumns=True)
    scores = [c for c in long.columns if c not in ("modelname", "sample_id", "_prio")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_prio"))).alias(c) for c in scores]
    return long.groupBy("modelname", "sample_id").agg(*first)


def write_upsert(spark: SparkSession, new: DataFrame, old_path: str | None, path: str, keys: list[str]) -> None:
    """Write ``new`` over the table at ``old_path`` by ``keys`` as a new table at ``path``; the old one stays until its owner drops it."""
    old = spark.read.parquet(old_path) if old_path else None
    merged = new if old is None else new.unionByName(old.join(new, keys, "left_anti"))
    merged.write.mode("overwrite").parquet(path)
