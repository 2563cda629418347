"""Hand-worked cases of functions and operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.functions import intervals as iv
from clipweave.functions import series as se
from clipweave.functions import text as tx
from clipweave.functions import vectors as v
from clipweave.operators import assign
from clipweave.operators.intervals import islands, nearest_fill, overlap_join
from clipweave.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def spans(*x):
    return [F.lit(float(i)) for i in x]


def test_hull_iou(spark):
    assert one(spark, iv.hull_iou(*spans(0, 2, 1, 3), delta=0.0)) == pytest.approx(1 / 3)
    assert one(spark, iv.hull_iou(*spans(0, 1, 3, 4), delta=0.0)) == 0


@pytest.mark.parametrize("x, name", [((0, 1, 1, 2), "M"), ((0, 1, 2, 3), "B"), ((0, 2, 1, 3), "O"), ((0, 1, 0, 2), "S"), ((1, 2, 0, 2), "F"), ((1, 2, 0, 3), "D"), ((0, 1, 0, 1), "E"), ((2, 3, 0, 1), "Bi"), ((0, 3, 1, 2), "Di")])
def test_allen(spark, x, name):
    assert one(spark, iv.allen(*spans(*x))) == name


def test_affinity(spark):
    assert one(spark, iv.affinity(F.lit("B"), F.lit("M"))) == 0.8 and one(spark, iv.affinity(F.lit("E"), F.lit("E"))) == 1 and one(spark, iv.affinity(F.lit("E"), F.lit("B"))) == 0


@pytest.mark.parametrize("cos, want", [(0.5, 0), (0.75, 0.5), (1, 1), (0.2, 0)])
def test_calibrated(spark, cos, want):
    assert one(spark, v.calibrated(F.lit(float(cos)), 0.5)) == pytest.approx(want)


def test_circular_emd(spark):
    arr = lambda *x: F.array(*map(F.lit, map(float, x)))
    for k in range(4):
        assert one(spark, se.circular_emd(arr(1, 0, 0, 0), arr(*np.roll([1, 0, 0, 0], k)), 4)) == 0
    assert one(spark, se.circular_emd(arr(0.5, 0.5, 0, 0), arr(0.5, 0, 0.5, 0), 4)) == 0.5
    assert one(spark, se.quantile_w1(arr(0, 1), arr(1, 2))) == 1


@pytest.mark.parametrize("mean, want", [(19.99, 1), (20, 2), (40, 3), (60, 4), (80, 5), (None, 1)])
def test_band(spark, mean, want):
    assert one(spark, tx.band(F.lit(mean).cast("double"))) == want


@pytest.mark.parametrize("key, value, want", [("number-or-id", "37", False), ("number-or-id", "137", True), ("color", "##", False), ("color", "red", True), ("color", "", False)])
def test_value_gate(spark, key, value, want):
    assert one(spark, tx.keeps_value(F.lit(key), F.lit(value))) is want


@pytest.mark.parametrize("raw, want", [('```json\n{"consistency": 140}```', 100), ("about 85 of 100", 85), ("none", 0), ("12345", 0), ('{"consistency": "7"}', 7)])
def test_judgement(spark, raw, want):
    assert one(spark, tx.judged_consistency(F.lit(raw))) == want


def test_normalise(spark):
    assert one(spark, tx.normalise(F.lit(' "Dark _ Red  Car!" '))) == "dark-red car"
    assert one(spark, tx.tolerant_float(F.lit(" 1,234.5% "))) == 1234.5 and one(spark, tx.tolerant_float(F.lit("n/a"))) is None
    assert one(spark, tx.stem(F.lit("https://a.b/c/d_001.mp4?x=1#y"))) == "d_001"


def test_assignment_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 6))
        c = rng.random((n, n))
        got = assign.solve(c)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sorted(got) == list(range(n)) and c[np.arange(n), got].sum() == pytest.approx(best)


def test_optimal_beats_greedy():
    s = np.array([[0.9, 0.8], [0.8, 0.1]])
    assert assign.padded(s, s > 0) == [(0, 1), (1, 0)]
    assert assign.greedy(s, 0.0) == [(0, 0), (1, 1)]
    assert assign.dummies(np.array([[0.5]]), 0.6) == []


def test_islands_and_overlap(spark):
    x = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.1, 4.0), (1, 9.0, 10.0), (2, 0.0, 1.0)], "k long, s double, e double")
    assert sorted(tuple(r) for r in islands(x, ["k"], tolerance=0.2).collect()) == [(1, 0.0, 4.0, 3), (1, 9.0, 10.0, 1), (2, 0.0, 1.0, 1)]
    got = {(r["s"], r["s_r"]) for r in overlap_join(x, x, ["k"], width=1.0).where("k = 1").collect()}
    assert got == {(a, b) for (a, e), (b, f) in itertools.product([(0.0, 2.0), (1.0, 3.0), (3.1, 4.0), (9.0, 10.0)], repeat=2) if a < f and b < e}


def test_nearest_fill(spark):
    x = spark.createDataFrame([(1, 0.0, "a"), (1, 1.0, None), (1, 2.0, "b"), (1, 9.0, None)], "k long, t double, v string")
    out = nearest_fill(x, ["k"], "t", "v", F.col("v").isNotNull(), most=2.0, out="f")
    assert [r["f"] for r in out.orderBy("t").collect()] == ["a", "a", "b", None]


def test_readers(spark, tmp_path):
    (tmp_path / "x_001_single.newevents.json").write_text('[{"id": "m0001", "s": 0.0, "e": 0.5, "s_abs": 0.0, "e_abs": 5.0}]')
    (tmp_path / "y_002_multi.newevents.json").write_text('{"events": [{"id": "m0001", "s": 0, "e": 1}, {"id": "m0002", "s": 1, "e": 2}]}')
    (tmp_path / "z.json").write_text("broken")
    got = sorted((r["sample_id"], r["id"]) for r in readers.read_events(spark, str(tmp_path)).collect())
    assert got == [("x_001_single", "m0001"), ("y_002_multi", "m0001"), ("y_002_multi", "m0002")]
    a = spark.createDataFrame([("m", "v.mp4", "1,5%")], ["Model", "Video", "S-Base"])
    b = spark.createDataFrame([("m", "v", "7", "3")], ["modelname", "sample_id", "s_base", "score"])
    one_, two = readers.read_scores(a, ("semantic_score",)), readers.read_scores(b, ("semantic_score", "world_score"))
    assert [tuple(r) for r in readers.merge_scores([one_, two]).collect()] == [("m", "v", 15.0, 3.0)]


def test_upsert(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    readers.write_upsert(spark, a, None, str(tmp_path / "1"), ["k"])
    readers.write_upsert(spark, b, str(tmp_path / "1"), str(tmp_path / "2"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "2")).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
