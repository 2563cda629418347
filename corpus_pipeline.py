"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.llm import catalog, line_dedup, mixing, ngram_join, pieces, quality_rules
from clipweave.llm.shared import cut
from clipweave.session import ship

#: Bytes that Spark sends to a Python worker at a time; its own measures, 64 MB and 10,000 rows, let whole texts take tens of MB on both sides.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ready(spark: SparkSession) -> SparkSession:
    """The session with the package shipped, and with batches of ``BATCH`` where it has no setting of its own."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    return ship(spark)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rules are learned from the labels of these documents."""
    return quality_rules.keep_good(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, n_chars counted anew; those of which nothing is left go."""
    ready(spark)
    clean = line_dedup.line_dedup(docs).where(F.trim("text") != "").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; rows that repeat that id stay together, rows without an id go."""
    ready(spark)
    kept = ngram_join.ngram_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budget of their leaf: at most one epoch, so that none repeats."""
    ready(spark)
    return mixing.mix_sources(docs, **catalog.MIX | {"fraction": 0.9, "max_epochs": 1})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's best segmentation, and scores of its four best."""
    ready(spark)
    return pieces.encode(docs, catalog.tokenizer_path("piece_bpe_32k.model"), nbest=4)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("mix_sources", mix), ("sentencepiece", encode)]
#: The learned rules, and N-best search over pieces, have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, with a written table between each two."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
