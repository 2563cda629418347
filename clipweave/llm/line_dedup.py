"""Line dedup by distinct-site spread, on DataFrame functions alone.

A HyperLogLog sketch of the sites of each line hash is built and merged by aggregation. Lines far above the
threshold are boilerplate, lines far below are not; those whose estimate is within the sketch's error of the
threshold get an exact distinct count. Boilerplate lines are then removed wherever they stand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

KEY = ("_h1", "_h2")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """A row per line that is not blank: document, text hash, position, 96-bit line hash, site."""
    exploded = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), F.col(site).alias("_site"), F.posexplode(_lines(F.col(text))).alias("_pos", "_line"))
    line = F.trim("_line")
    return exploded.where(line != "").select("_doc", "_text", "_site", "_pos", F.xxhash64(line).alias(KEY[0]), F.hash(line).alias(KEY[1]))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    """Hashes of the lines that stand on ``min_sites`` sites or more; exact, save for a sketch over 5 standard errors off."""
    margin = 5 * 1.04 / math.sqrt(2**lg_k)
    spread = cut(lines.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("_sites")).where(F.col("_sites") >= math.floor(min_sites * (1 - margin))), "line-spread")
    sure, near = spread.where(F.col("_sites") > math.ceil(min_sites * (1 + margin))), spread.where(F.col("_sites") <= math.ceil(min_sites * (1 + margin)))
    pairs = lines.join(near, list(KEY), "left_semi").select(*KEY, "_site").distinct()
    exact = pairs.groupBy(*KEY).agg(F.count("_site").alias("_sites")).where(F.col("_sites") >= min_sites)
    return sure.select(*KEY).union(exact.select(*KEY))


def line_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8, lg_k: int = 10) -> DataFrame:
    """All rows and columns of ``docs``, boilerplate lines gone from ``text``, and ``n_lines`` and ``n_removed``.

    Lines are parted by ``\\n`` and compared without spaces at their ends. Blank lines are never boilerplate and stay.
    A null site counts for no line. A null text stays null with 0 lines; an empty one has 1 line. Repeated rows are
    each treated alike, and rows with a null id too. Columns of ``docs`` called ``n_lines`` or ``n_removed`` are replaced.
    """
    lines = cut(line_table(docs, doc_id, text, site), "lines")
    hit = lines.join(boilerplate(lines, min_sites, lg_k), list(KEY), "left_semi").groupBy("_doc", "_text").agg(F.collect_set("_pos").alias("_drop"))
    joined = docs.drop("n_lines", "n_removed").join(hit, F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col(text)) == F.col("_text")), "left")
    n = F.size(_lines(F.col(text)))
    # The one-element array binds the lines once, so that each kept position is a look-up.
    kept = F.flatten(F.transform(F.array(_lines(F.col(text))), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop")), lambda p: F.get(ls, p))))
    columns = [F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.coalesce(F.when(F.col(text).isNotNull(), n), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(F.array_compact("_drop")), F.lit(0)).cast("long").alias("n_removed"))
