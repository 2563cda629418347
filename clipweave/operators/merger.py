"""Merging adjacent events of a clip by meaning and time, with the map of members, centroids and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.jobs import written
from .pooling import pooled
from .prefix import with_before

#: Places to cut a key at that lie within a piece, so that few pieces need the end of the one before.
CUTS = 64
REASONS = ("short", "no_vector", "first", "low_similarity", "large_gap", "merged")


def _fold(similarity: float, gap: float):
    """Clusters of pieces: rows (key, piece, s, e, id, x) come sorted; many pieces lie in a batch, and a piece may go on in the next.

    Emits (key, piece, id, cluster, reason, own, tail): the cluster's number in its piece, of a piece's first row its own vector, as its
    reason is left open, and of a piece's last row the direction that its last cluster has.
    """
    names, vector = ("key", "piece", "id", "cluster", "reason", "own", "tail"), pa.list_(pa.float64())
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), vector, vector), strict=True)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, upto, centre, held = None, 0, 0.0, None, None
        for batch in it:
            out: list[tuple] = []
            key, piece, ids = (batch.column(c).to_pylist() for c in ("key", "piece", "id"))
            s, e = (np.asarray(batch.column(c), float).tolist() for c in ("s", "e"))
            flat, sizes = np.asarray(batch.column("x").flatten(), float), np.asarray(pc.fill_null(batch.column("x").value_lengths(), 0))
            ends, has = np.cumsum(sizes).tolist(), batch.column("x").is_valid().to_pylist()
            for k in range(len(ids)):
                vec = flat[ends[k] - sizes[k] : ends[k]] if has[k] else None
                head = (key[k], piece[k]) != now
                if head:
                    if held is not None:
                        out.append((*held, centre))
                    now, number, centre = (key[k], piece[k]), 0, None
                elif held is not None:
                    out.append((*held, None))
                reason = "no_vector" if vec is None else None if head else "low_similarity"
                if vec is not None and centre is not None:
                    near = alike(centre, vec) >= similarity
                    reason = "low_similarity" if not near else "merged" if max(0.0, s[k] - upto) <= gap else "large_gap"
                if reason == "merged":
                    upto, centre = max(upto, e[k]), centre + (e[k] - s[k]) * vec
                else:
                    number, upto, centre = number + 1, e[k], None if vec is None else (e[k] - s[k]) * vec
                held = (key[k], piece[k], ids[k], number, reason, vec if head and piece[k] else None)  # nothing comes before piece 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*held, centre), strict=True))], schema=schema)

    return run


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """(cos + 1) / 2 of two vectors, one half where one has no length."""
    return (float(a @ b) / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-12) + 1) / 2


def merge_items(items: DataFrame, *, similarity: float = 0.93, gap: float = 0.1, least: float = 2e-3, bucket: float = 86400.0) -> DataFrame:
    """(key, id, cluster, reason) of items (key, id, s, e, x): the cluster that each has gone to, null for those left out, and why.

    An item joins the cluster before it if its vector is like the cluster's duration-weighted centroid, (cos + 1) / 2 at least ``similarity``,
    and it begins no later than ``gap`` after its end. Items shorter than ``least``, and those without a vector before the first with one, are left
    out; later ones without a vector stand alone.

    Who joins whom depends on all members before, but never across an item that begins over ``gap`` after everything before it has ended:
    keys are cut there into pieces of ``CUTS`` such places, which are folded apart. Vectors move once to their places and once to their pieces. Ids are unique within a key. ``bucket`` is the time by which long keys are spread for the cutting. A key
    without such a place is one piece, which a task goes through row by row.
    """
    own = items.select("key", "id", "s", "e", F.col("x").isNotNull().alias("_has"))
    short = own.where(F.col("e") - F.col("s") < least)
    kept = own.where(F.col("e") - F.col("s") >= least)
    first = kept.where("_has").groupBy("key").agg(F.min(F.struct("s", "e", "id")).alias("_first"))
    timed = kept.join(first, "key", "left").withColumn("_live", F.coalesce(F.struct("s", "e", "id") >= F.col("_first"), F.lit(False)))
    order, by = ["s", "e", "id"], F.floor(F.col("s") / bucket)
    slim = with_before(timed.where("_live").select("key", *order), "key", by, order, maxima={"_upto": F.col("e")})
    cuts = slim.withColumn("_cut", F.coalesce(F.col("s") - F.col("_upto") > gap, F.lit(False)).cast("long"))
    placed = with_before(cuts, "key", by, order, sums={"_cuts": F.col("_cut")}).select("key", *order, F.floor((F.col("_cuts") + F.col("_cut")) / CUTS).alias("piece"))
    rows = placed.join(items.select("key", "id", "x"), ["key", "id"]).select("key", "piece", *order, "x")
    schema = "key long, piece long, id long, cluster long, reason string, own array<double>, tail array<double>"
    folded = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", *order).mapInArrow(_fold(similarity, gap), schema)
    folded = written(folded, "merge-folded")

    pieces = folded.groupBy("key", "piece").agg(F.max("cluster").alias("n"), F.max("tail").alias("tail"))
    offset = with_before(pieces, "key", F.floor(F.col("piece") / 1000), ["piece"], sums={"before": F.col("n")}).select("key", "piece", "before")
    tails = pieces.select("key", (F.col("piece") + 1).alias("piece"), F.col("tail").alias("_tail"), F.lit(True).alias("_follows"))
    # Why a first row did not join the cluster before it: what it is unlike, or only too late for.
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    cos = dot("_tail", "own") / F.greatest(F.sqrt(dot("_tail", "_tail")) * F.sqrt(dot("own", "own")), F.lit(1e-12))
    why = F.when(F.col("_follows").isNull(), "first").when((cos + 1) / 2 >= similarity, "large_gap").otherwise("low_similarity")
    done = folded.join(offset.join(tails, ["key", "piece"], "left"), ["key", "piece"])
    done = done.select("key", "id", (F.col("cluster") + F.col("before")).alias("cluster"), F.coalesce("reason", why).alias("reason"))
    out = lambda t, why: t.select("key", "id", F.lit(None).cast("long").alias("cluster"), F.lit(why).alias("reason"))
    return done.unionByName(out(short, "short")).unionByName(out(timed.where("not _live"), "no_vector"))


def clusters(items: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, name, s, e, n, members, dur): one row per cluster, named by its number."""
    both = items.select("key", "id", "s", "e").join(placed.where("cluster is not null"), ["key", "id"])
    members = F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "id"))), lambda m: m["id"])  # of one clip
    out = both.groupBy("key", "cluster").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), members.alias("members"))
    return out.select("key", F.format_string("m%04d", "cluster").alias("name"), "s", "e", "n", "members", (F.col("e") - F.col("s")).alias("dur"))


def centroids(items: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, name, i, x): the duration-weighted mean direction of each cluster that has vectors, of length 1, a row per place."""
    both = items.join(placed.where("cluster is not null"), ["key", "id"])
    own = both.select(F.struct("key", "cluster").alias("key"), (F.col("e") - F.col("s")).alias("w"), "x")
    unit = pooled(own).where("x is not null").select("key.key", "key.cluster", F.posexplode("x").alias("i", "x"))
    return unit.select("key", F.format_string("m%04d", "cluster").alias("name"), "i", "x")


def statistics(placed: DataFrame) -> DataFrame:
    """Counters of a clip: items, kept, clusters, merged, and those that each rule kept apart or out."""
    of = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return placed.groupBy("key").agg(F.count("*").alias("items"), F.count("cluster").alias("kept"), F.coalesce(F.max("cluster"), F.lit(0)).alias("clusters"), *(of(r) for r in REASONS if r != "first"))
