"""Cases from the findings of round 3, each against the query's SQL on small tables of its own."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from clipweave.operators import set_join
from clipweave.plans.catalog import QUERIES, SQL

from .conftest import plain

START = pd.Timestamp("2024-01-01")


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over the given tables."""
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.to_parquet(tmp_path / f"{t}.parquet", index=False, coerce_timestamps="us")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    return plain(QUERIES[name](spark, str(tmp_path)).toPandas()), plain(con.execute(SQL[name]).df())


def events(rows):
    """Events (event_id, seconds, user_id, value)."""
    out = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"])
    return out.assign(ts=START + pd.to_timedelta(out.ts, unit="s"), event_type="view", props='{"k": 1}')


def test_relation_spans_are_summed_as_they_are(spark, tmp_path):
    """ends rounded to a tenth would make 1,849.97 seconds 1,850, and 18 hundreds 19."""
    got, want = both(spark, tmp_path, "relation_span_fallback", events=events([(2, 0.04, 1, 1849.97 / 600), (3, 0.04, 1, 1849.97 / 600)]))
    assert got == want and len(got) == 1


def test_sets_that_cannot_be_similar_do_not_meet(spark):
    """F1: sets of five are 0.7 alike only if equal, so of 400 different ones that share sizes and brands no pair is a candidate; copies come back whole."""
    sets = {k: [f"size={k % 5}", f"brand={k // 5 % 4}", f"type={k // 20 % 4}", f"a={k // 80 % 5}", "x"] for k in range(400)}
    frame = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s], "id long, member string")
    shaped = frame.groupBy("id").agg(F.array_sort(F.collect_list("member")).alias("members")).withColumn("n", F.size("members"))
    assert set_join._short_pairs(spark, shaped, 0.7).count() == 0
    twice = frame.union(frame.selectExpr("id + 1000", "member")).union(frame.where("id < 3").selectExpr("id + 2000", "member"))
    got = {(r["a"], r["b"]) for r in set_join.similar_sets(twice, 0.7).collect()}
    assert got == {(k, k + 1000) for k in sets} | {(k + a, k + 2000) for k in range(3) for a in (0, 1000)}


def test_similar_sets_of_all_sizes(spark):
    """sets under and over the size up to which they meet by several members."""
    rng = np.random.default_rng(8)
    base = [rng.permutation(80)[: int(n)].tolist() for n in rng.integers(1, 50, 60)]
    sets = {3 * k + j: set(b[j:]) | {100 + int(rng.integers(4))} for k, b in enumerate(base) for j in (0, 1, 2)}
    frame = spark.createDataFrame([(k, f"m{m}") for k, s in sets.items() for m in s], "id long, member string")
    for least in (0.4, 0.7, 0.9):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        got = set_join.similar_sets(frame, least).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_parts_of_few_signatures_meet_in_many_tasks(spark, tmp_path):
    """a small file of parts is one task's input, but its pairs are not one task's output."""
    part = pd.DataFrame({"p_partkey": range(600), "p_name": "x", "p_brand": "Brand#1", "p_type": [f"T{k % 2}" for k in range(600)], "p_size": [k % 20 for k in range(600)]})
    got, want = both(spark, tmp_path, "entity_match_score", part=part)
    assert got == want and len(got) > 10_000
    used = QUERIES["entity_match_score"](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1


def test_direction_of_long_vectors_is_one_pass(spark):
    """the length of a sum is worked out once, not for each of its 20,000 places; one part and many give the same."""
    from clipweave.operators.pooling import pooled

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 20_000))
    frame = spark.createDataFrame([(1, 1.0, x[0].tolist()), (2, 1.0, x[1].tolist()), (2, 2.0, x[2].tolist()), (3, 1.0, [3.0]), (3, 1.0, [0.0, 4.0]), (4, 1.0, [0.0])], "key int, w double, x array<double>")
    got = {r["key"]: r["x"] for r in pooled(frame.repartition(3)).collect()}
    for key, want in ((1, x[0]), (2, x[1] + 2 * x[2])):
        assert np.allclose(got[key], want / np.linalg.norm(want))
    assert np.allclose(got[3], [0.6, 0.8]) and got[4] is None


def test_merge_ends_of_pieces_that_nothing_follows_hold_no_vectors(spark):
    """a key with fewer cuts than a piece takes has one piece; of longer ones the reasons at the ends are those of one fold."""
    from clipweave.operators import merger

    rng = np.random.default_rng(3)
    rows = [(1, k, 10.0 * k, 10.0 * k + 1, [1.0, float(rng.integers(0, 3))]) for k in range(200)]
    items = spark.createDataFrame(rows, "key long, id long, s double, e double, x array<double>")
    got = {r["id"]: (r["cluster"], r["reason"]) for r in merger.merge_items(items, similarity=0.95, gap=0.1, bucket=70.0).collect()}
    near = lambda a, b: merger.alike(np.array(a), np.array(b)) >= 0.95
    want = {k: (k + 1, "first" if not k else "large_gap" if near(rows[k - 1][4], rows[k][4]) else "low_similarity") for k in range(200)}
    assert got == want
    heads = list(merger._fold(0.95, 0.1)(iter([pa.RecordBatch.from_pylist([{"key": 1, "piece": p, "s": 0.0, "e": 1.0, "id": p, "x": [1.0]} for p in (0, 1)])])))
    assert [r["own"] for b in heads for r in b.to_pylist()] == [None, [1.0]]


def test_attribute_maps_normalise_once(spark):
    """a key and its values are each normalised at one place of the expression."""
    from clipweave.functions import evidence as ev

    entries = F.expr("array(struct('a' as key, array('Red') as values))")
    assert str(ev.normal_attributes(entries)).count("lower(") <= 2


def test_shared_steps_are_worked_out_once(spark):
    """F7, F8, F9: candidates of a certificate, and matches of event scores, are written and not worked out again by each use."""
    from clipweave.operators import assign, events as ev

    pairs = spark.range(40).selectExpr("id % 4 as key", "id div 4 as ref_id", "id div 4 + 100 as gen_id", "0.5 as score", "true as gated")
    side = lambda k: spark.createDataFrame([(a, b + k, float(b), b + 2.0) for a in range(4) for b in range(10)], "key long, id long, s double, e double")
    for out in (assign.certificate(pairs), ev.event_scores(pairs.withColumnRenamed("score", "q"), side(0), side(100))):
        assert "Range (" not in out._jdf.queryExecution().toString() and out.count() == 4


def test_value_gates_of_whole_texts(spark, tmp_path):
    """words of a text normalised as a whole are those normalised one by one, over repeated ids too."""
    texts = ["A-b a_B\nab  x1 1 İstanbul ΣΣ café\tx y2z", "ab cd", None, "", " \n- 12 a", "CD ef"]
    got, want = both(spark, tmp_path, "value_filter_gates", documents=pd.DataFrame({"doc_id": [1, 1, 2, 3, 4, 5], "text": texts}))
    assert got == want and len(got) == 2


def test_reports_of_all_events_are_dug(spark, tmp_path):
    """every event has a report, of all six layouts; four of them give scores."""
    got, want = both(spark, tmp_path, "dig_event_scores", events=events([(k, float(k), 1, 1.0) for k in range(24)]))
    assert got == want and len(got) == 16


def test_pipeline_workers_hold_little(spark):
    """pipeline, memory of an executor: steps in Python go by slices of text, Spark's batches are small, and a worker keeps no units after its task."""
    import corpus_pipeline
    from clipweave.llm import catalog, pieces, quality_rules

    texts = [" ".join(f"word{(k * j) % 997}x" for j in range(30_000)) for k in range(1, 9)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(9)], "text": [*texts, None]})
    path = catalog.tokenizer_path("piece_bpe_32k.model")
    model = pieces.lattice(path)
    want = [(ids[0].tolist(), scores) for ids, scores in model.nbest_of([*texts, ""], 4)]
    out = list(pieces._encode(path, 4)(iter([batch])))
    assert [(r["ids"], r["scores"]) for b in out for r in b.to_pylist()] == want and len(out) >= 4 and not model.known and not model.searched

    parts = list(quality_rules._batches(iter([batch])))
    assert [tuple(r.values())[1:] for b in parts for r in b.to_pylist()] == [quality_rules.text_stats(t.encode()) for t in [*texts, ""]] and len(parts) >= 2

    key = corpus_pipeline.BATCH[0]
    held = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        corpus_pipeline.ready(spark)
        rows = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
        sizes = [r["n"] for r in rows.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()]
        assert len(sizes) >= 3 and max(sizes) < 5 << 20
        spark.conf.set(key, "1234567")
        corpus_pipeline.ready(spark)
        assert spark.conf.get(key) == "1234567"
    finally:
        spark.conf.set(key, held) if held else spark.conf.unset(key)
