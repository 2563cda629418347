"""The registered queries of the subpackage against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from clipweave.llm import catalog
from clipweave.llm.shared import cut

from ..conftest import SF, plain
from .test_operators import jaccard_sets, linked


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = cut(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and len(after) == docs.count()
        if name == "ngram_jaccard_join":
            assert set(after) == {d for d, c in linked(jaccard_sets(before)).items() if d == c}
        seen.append(len(after))
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == seen[-1] and out.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an extra column of a clashing name, and no rows at all."""
    long = " ".join(f"w{k}x{k % 97}" for k in range(20_000))
    rows = [(1, long, "en", "s1", 5, "a"), (1, long, "en", "s1", 5, "a"), (2, None, "en", "s1", None, "a"), (3, "", None, None, 0, None), (None, long + " end", "de", "s2", 1, "b"), (4, " ".join(f"v{k}" for k in range(80)), None, None, 9, None), (5, " ".join(f"v{k}" for k in range(80)), "en", "s1", 9, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 1, 0), (None, 0, None), (4, None, 1)], labels).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        total = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= total and (name == "sentencepiece" or out.columns == docs.columns)
            if total and name == "ngram_jaccard_join":
                assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4}
            if total and name == "quality_rules":
                assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "4", "5", "None"]
