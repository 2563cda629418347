"""Stateful streams: rows of a key handed to a fold in event-time order, with state and timers, however the micro-batches are shuffled.

Rows are held in the state store until the watermark has passed them, so that what comes out is what the fold makes of the whole log in
order. A fold may ask to be woken at a time, as for time-outs. Folds: the task machine, the guard against repeated submissions, and
the resolution of entities across windows as windows arrive.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.entities import Known
from ..operators.sequence import MOVES, OPEN
from .jobs import place_of

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (key, state, rows (at, seq, row) in order, up to when) -> (rows out, new state, when to wake); times in microseconds.
Fold = Callable[[str, object, list, int], tuple[list, object, "int | None"]]
_OUT = "key string, at long, seq long, row string"


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds them in the order of (at, seq)."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, seq long, row string")
        self.known = handle.getValueState("known", "state string, wake long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in zip(frame["at"].tolist(), frame["seq"].tolist(), frame["row"].tolist(), strict=True)]
        self.held.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready, rest = sorted(r for r in held if r[0] < upto), [r for r in held if r[0] >= upto]
        text, wake = self.known.get() if self.known.exists() else ("null", -1)
        if not ready and not 0 <= wake < upto:
            return iter(())  # an older timer of what has been done since
        out, state, wake = self.fold(key[0], json.loads(text), ready, upto)
        self.known.update((json.dumps(state), -1 if wake is None else wake))
        if ready:
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        if coming := [t for t in (min((r[0] for r in rest), default=None), wake) if t is not None]:
            self._wake(min(coming))
        if not out:
            return iter(())
        return iter([pd.DataFrame([(key[0], at, seq, json.dumps(row)) for at, seq, row in out], columns=["key", "at", "seq", "row"])])


def in_order(stream: DataFrame, fold: Fold, *, late: str, result: str) -> DataFrame:
    """(key, at, seq, fields of ``result``) that ``fold`` makes of a stream (key, ts, seq, other columns), rows up to ``late`` out of order.

    Rows without a key or time take no part; rows later than the watermark are left out. The other columns reach the fold as a dict.
    """
    own = stream.where("key is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rest = [c for c in stream.columns if c not in ("key", "ts", "seq")]
    row = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    slim = own.select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), row.alias("row"))
    out = slim.groupBy("key").transformWithStateInPandas(InOrder(fold), _OUT, "append", "eventTime")
    return out.select("key", "at", "seq", F.from_json("row", result).alias("x")).select("key", "at", "seq", "x.*")


class TaskMachine:
    """States of tasks and whether they may turn so; a task that stays open for ``limit`` seconds has failed by then."""

    RESULT = "status string, before string, legal boolean, timed_out boolean"

    def __init__(self, limit: float):
        self.limit = int(limit * 1e6)

    def __call__(self, key, state, rows, upto):
        out, now = [], tuple(state) if state else None  # (status, since)
        end = lambda at, seq: out.append((at, seq, {"status": "failed", "before": now[0], "legal": (now[0], "failed") in MOVES, "timed_out": True}))
        for at, seq, row in rows:
            status = json.loads(row)["status"]
            if now and now[0] in OPEN and at > now[1] + self.limit:
                end(now[1] + self.limit, -1)
                now = ("failed", now[1] + self.limit)
            legal = (now[0], status) in MOVES if now else status == "pending"
            out.append((at, seq, {"status": status, "before": now[0] if now else None, "legal": legal, "timed_out": False}))
            now = (status, at)
        if now and now[0] in OPEN and now[1] + self.limit < upto:
            end(now[1] + self.limit, -1)
            now = ("failed", now[1] + self.limit)
        return out, now, now[1] + self.limit if now and now[0] in OPEN else None


class Guard:
    """Whether submissions are taken: not while one of the same name is open, nor after one has been completed; a failed one may be repeated."""

    RESULT = "kind string, accepted boolean"

    def __call__(self, key, state, rows, upto):
        out = []
        for at, seq, row in rows:
            kind = json.loads(row)["kind"]
            accepted = kind == "submit" and state in (None, "failed")
            if kind == "submit":
                state = "open" if accepted else state
            elif state == "open" and kind in ("completed", "failed"):
                state = kind
            out.append((at, seq, {"kind": kind, "accepted": accepted}))
        return out, state, None


class Resolver:
    """Global names of the entities of a window, once the window is over; all rows of a window have its time as ``ts``."""

    RESULT = "win long, local_id long, entity string"

    def __call__(self, key, state, rows, upto):
        known, out, at = Known(state), [], 0
        while at < len(rows):
            window = [r for r in rows[at:] if r[0] == rows[at][0]]
            parsed = sorted((json.loads(r[2]) for r in window), key=lambda x: x["local_id"])
            for x, entity in zip(parsed, known.window(parsed), strict=True):
                out.append((window[0][0], x["local_id"], {"win": x["win"], "local_id": x["local_id"], "entity": entity}))
            at += len(window)
        return out, known.state(), None


def replay(spark: SparkSession, log: DataFrame, fold: Fold, *, late: str, result: str, name: str, files: int = 4) -> DataFrame:
    """What ``fold`` makes of a log (key, ts, seq, ..) that comes in ``files`` shuffled micro-batches, and after them a row that ends it.

    The log is written as files in an order that has nothing to do with time; ``late`` must span it. The last row, of no key of the log, moves the
    watermark past all others, so that every row and timer comes due.
    """
    place = place_of(spark, name)
    own = log.withColumns({"key": F.col("key").cast("string"), "ts": F.col("ts").cast("timestamp")})
    own.repartition(files, F.xxhash64("key", "seq")).write.parquet(f"{place}/log")
    far = own.agg(F.max("ts").alias("ts")).select(F.lit("").alias("key"), (F.col("ts") + F.expr(f"2 * interval '{late}' + interval '3650 days'")).alias("ts"), F.lit(0).cast("long").alias("seq"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema if f.name not in ("key", "ts", "seq")]
    far.select("*", *none).select(own.columns).coalesce(1).write.mode("append").parquet(f"{place}/log")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/log")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the store that keeps lists and timers
    try:
        out = in_order(stream, fold, late=late, result=result).where("key <> ''")
        q = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.schema(out.schema).parquet(f"{place}/out")
