"""Table functions for SQL text: ``micro_events`` and ``clip_windows``, to be called by LATERAL once ``register`` has been."""

from __future__ import annotations

import math
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Where a caption is cut, and parts of it at most.
CUT, MOST = re.compile(r"[|。:;.]"), 8


def _fields(**types: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in types.items()])


@udtf
class MicroEvents:
    """micro_events(id, caption): (event_id, parent_id, k, clause) of each clause of a caption; none of a null one."""

    @staticmethod
    def analyze(parent: AnalyzeArgument, caption: AnalyzeArgument) -> AnalyzeResult:
        if caption.dataType.typeName() not in ("string", "void"):
            raise ValueError(f"the caption must be a string, not {caption.dataType.simpleString()}")
        return AnalyzeResult(_fields(event_id=StringType(), parent_id=StringType(), k=IntegerType(), clause=StringType()))

    def eval(self, parent, caption):
        parts = [p for p in (x.strip(" ") for x in CUT.split(caption or "")) if p]
        for k, clause in enumerate(parts[:MOST], 1):
            yield f"{parent}#{k}", str(parent), k, clause


@udtf
class ClipWindows:
    """clip_windows(seconds, size, hop): (k, s, e) of windows of ``size`` every ``hop`` seconds, the last cut at the end; one of no length of an empty clip."""

    @staticmethod
    def analyze(seconds: AnalyzeArgument, size: AnalyzeArgument, hop: AnalyzeArgument) -> AnalyzeResult:
        for name, arg in (("size", size), ("hop", hop)):
            if arg.isConstantExpression and arg.value is not None and arg.value <= 0:
                raise ValueError(f"{name} must be over 0")
        return AnalyzeResult(_fields(k=IntegerType(), s=DoubleType(), e=DoubleType()))

    def eval(self, seconds, size, hop):
        if seconds is None:
            return
        seconds, size, hop = float(seconds), float(size), float(hop)
        for k in range(max(0, math.ceil((seconds - size) / hop)) + 1 if seconds > 0 else 1):
            yield k, k * hop, min(seconds, k * hop + size)


def register(spark: SparkSession) -> SparkSession:
    """Make both functions known to the session's SQL."""
    spark.udtf.register("micro_events", MicroEvents)
    spark.udtf.register("clip_windows", ClipWindows)
    return spark
