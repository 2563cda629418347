"""Library functions against hand-worked cases and plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipweave.functions import intervals as iv
from clipweave.functions.event_total import event_total
from clipweave.functions import table_functions
from clipweave.operators import assign, axes, boards, cache, entities, events, merger, motion, peaks, pooling, quantiles, sequence, set_join, similar, sparse
from clipweave.plans import q_axes
from clipweave.streaming import stateful

from .conftest import SF


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_event_scores_by_hand(spark):
    refs = spark.createDataFrame([(1, 10, 0.0, 4.0), (1, 11, 4.0, 5.0), (1, 12, 9.0, 9.0), (1, 13, 7.0, 8.0), (2, 20, 0.0, 1.0)], "key long, id long, s double, e double")
    gens = spark.createDataFrame([(1, 30, 0.0, 2.0), (1, 31, 2.0, 3.0), (1, 32, 5.0, 6.0)], "key long, id long, s double, e double")
    matches = spark.createDataFrame([(1, 10, 30, 0.9), (1, 11, 31, 0.6)], "key long, ref_id long, gen_id long, q double")
    got = {r["key"]: r for r in events.event_scores(matches, refs, gens).collect()}
    assert got[1]["ega"] == pytest.approx(80) and got[1]["erel"] == pytest.approx(100) and got[1]["ecr"] == pytest.approx(57.142857, abs=1e-5)
    assert got[1]["s_event"] == pytest.approx(0.2 * 80 + 0.2 * 100 + 0.6 * 57.142857, abs=1e-5)
    assert (got[2]["ega"], got[2]["erel"], got[2]["ecr"], got[2]["s_event"]) == (None, None, 0.0, 0.0)
    total = lambda *a, **k: spark.range(1).select(event_total(*(F.lit(x).cast("double") for x in a), **k).alias("x")).first()["x"]
    assert total(80, None, 50) == 56 and total(80, None, 50, without="equal") == 65 and total(80, None, 50, without="proportional") == pytest.approx(57.5)


def test_relation_affinities(spark):
    a = lambda x, y, f: spark.range(1).select(f(F.lit(x), F.lit(y)).alias("x")).first()["x"]
    own = lambda x, y: iv.custom_affinity(x, y, {("B", "M"): 0.3, ("M", "B"): 0.5})
    assert a("M", "B", own) == 0.5 and a("B", "B", own) == 1.0 and a("B", "O", own) == 0.0
    assert a("B", "M", lambda x, y: iv.custom_affinity(x, y, {})) == 0.0  # identity


def _calibrated(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return max(0.0, min(1.0, float(a @ b) / n)) if n else 0.0


def test_semantic_axes_by_hand(spark):
    """The optimal query's scores, step by step in Python over the matches that the assignment gave."""
    em = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    value = {k: v for k, v in em.items() if k < 40}
    attrs = {e: {(f"k{(e // 2 + j) % 3}", (e * (7 + 4 * j) + j) % 40) for j in (0, 1)} for e in em}
    weight = lambda k: q_axes.WEIGHTS.get(k, 1.0)
    got = {r["sample"]: r for r in q_axes.s_base_optimal(spark, SF).collect()}
    for sample in sorted({e // 16 for e in em}):
        ref, gen = ([e for e in em if e // 16 == sample and e % 2 == side] for side in (0, 1))
        if not ref or not gen:
            continue
        sim = np.array([[0.4 * _calibrated(em[r][:32], em[g][:32]) + 0.6 * _calibrated(em[r][32:], em[g][32:]) for g in gen] for r in ref])
        pairs = assign.dummies(sim, q_axes.GATE)
        star = lambda k, v: max((_calibrated(value[v], value[w]) for r in ref for kk, w in attrs[r] if kk == k), default=None)
        cn = cd = mn = md = ea = aw = 0.0
        for i, j in pairs:
            keys = {k for k, _ in attrs[ref[i]]}
            for k in keys:
                hits = [max((_calibrated(value[v], value[w]) for kk, w in attrs[gen[j]] if kk == k), default=0.0) for kk2, v in attrs[ref[i]] if kk2 == k]
                cn += weight(k) * sum(hits) / len(hits)
            cd += max(sum(map(weight, keys)), 1e-8)
            pn = pd_ = 0.0
            for k, v in attrs[gen[j]]:
                s = star(k, v)
                ea, aw = ea + weight(k) * (1 - (s or 0.0)), aw + weight(k)
                if s is not None:
                    own = max((_calibrated(value[v], value[w]) for kk, w in attrs[ref[i]] if kk == k), default=0.0)
                    pn, pd_ = pn + weight(k) * max(0.0, s - own), pd_ + weight(k) * s
            mn, md = mn + pn, md + max(pd_, 1e-8)
        catcov = 100 * sum(sim[i, j] for i, j in pairs) / len(ref)
        aic = 100 * (cn / (cd + 1e-8)) * (1 - min(1.0, mn / (md + 1e-8))) if pairs else 0.0
        taken = {j for _, j in pairs}
        extra = sum(1 - sim[:, j].max() for j in range(len(gen)) if j not in taken)
        par = 100 * (1 - min(1.0, (extra + ea) / (len(gen) + max(aw, 1e-8) + 1e-8)))
        r = got[sample]
        assert (r["catcov"], r["aic"], r["par"], r["s_base"]) == pytest.approx((catcov, aic, par, 0.3 * catcov + 0.4 * aic + 0.3 * par), abs=2e-4)


def test_axes_edges(spark):
    side = "sample long, id long, name_vec array<double>, set_vec array<double>"
    refs = spark.createDataFrame([(1, 1, [1.0, 0.0], None), (2, 2, [0.0, 0.0], [0.0, 1.0])], side)
    gens = spark.createDataFrame([(1, 5, [1.0, 0.0], [1.0, 0.0]), (2, 6, [0.0, 1.0], [0.0, 1.0])], side)
    sims = axes.entity_similarity(refs, gens)
    assert rows(sims.select("sample", "sim")) == [(1, 0.4), (2, 0.6)]
    assert rows(axes.entity_similarity(refs, gens, max_of=True).select("sim")) == [(1.0,), (1.0,)]
    attrs = spark.createDataFrame([], "sample long, id long, key string, value string")
    values = axes.value_similarity(attrs, attrs, spark.createDataFrame([], "value string, vec array<double>"))
    matches = axes.mutual_best(sims, gate=0.5)
    assert rows(matches.select("sample")) == [(2,)]
    assert rows(axes.binding(matches, attrs, attrs, values, {})) == [(2, 0.0, 0.0, 0.0)]
    par = axes.parsimony(gens, sims, matches, attrs, values, {})
    assert {r["sample"]: round(r["par"], 4) for r in par.collect()} == {1: 40.0, 2: 100.0}


def test_motion_by_hand(spark):
    t = [("c", "ref", "fg", p, k, float(k * (1 + p)), 0.0, not (p == 1 and k == 2), 0.5 + p) for p in (0, 1) for k in range(5)]
    vel = {r["t"]: (r["vx"], r["vy"]) for r in motion.velocities(spark.createDataFrame(t, "clip string, side string, lane string, pt long, t long, x double, y double, vis boolean, wtex double")).collect()}
    assert set(vel) == {1, 2, 3, 4} and vel[1][0] == pytest.approx((0.5 * 1 + 1 * 2) / (1.5 + 1e-6)) and vel[2][0] == pytest.approx(0.5 / (0.5 + 1e-6))
    rel = spark.createDataFrame([("c", "ref", 1, 0.0, 0.0), ("c", "ref", 2, 1.0, 0.0), ("c", "gen", 1, -1.0, 0.0)], "clip string, side string, t long, rx double, ry double")
    f = {r["side"]: r for r in motion.features(rel, bins=4).collect()}
    assert f["ref"]["hof"] == [0, 0, 2, 0] and f["gen"]["hof"] == [0, 0, 0, 1] and f["ref"]["phi"] == [0.0, 0.0, 0.0]
    d = motion.distances(motion.features(rel, bins=4), bins=4).first()
    assert d["d_dir"] == 0.0 and d["d_mag"] == pytest.approx(0.5) and d["d_smo"] == 0.0
    frames = spark.createDataFrame([("c", 0, [1.0, 2.0, 3.0, 4.0, 5.0, 5.0]), ("c", 1, [2.0, 4.0, 6.0, 1.0, 9.0, 2.0])], "clip string, t long, pixels array<double>")
    ncc = {r["p"]: r["ncc"] for r in motion.patch_similarity(frames, patch=3).collect()}
    a, b = np.array([4.0, 5, 5]) - 14 / 3, np.array([1.0, 9, 2]) - 4
    assert ncc[0] == pytest.approx(1, abs=1e-5) and ncc[1] == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-6))
    frz = spark.range(1).select(motion.freeze(F.lit(0.5), F.lit(0.4), F.lit(2.0)).alias("x"), motion.freeze(F.lit(0.5), F.lit(0.4), F.lit(0.1)).alias("y")).first()
    assert (frz["x"], frz["y"]) == (pytest.approx(0.47), 0.0)


def test_sequences_by_hand(spark):
    clips = spark.createDataFrame([(1, 10, 2.0), (2, 0, 1.0), (3, 4, 1.0)], "clip long, n_frames long, fps double")
    cuts = spark.createDataFrame([(1, 4), (1, 4), (1, 0), (1, 12), (1, -1)], "clip long, t long")
    assert rows(sequence.scenes(cuts, clips)) == [(1, 0.0, 0.0), (1, 0.0, 2.0), (1, 2.0, 5.0), (3, 0.0, 4.0)]
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 0.05)], "clip long, t0 double, t1 double")
    bounds = spark.createDataFrame([(1, 3.0), (1, 3.05), (1, 12.0)], "clip long, at double")
    assert rows(sequence.segments_between(bounds, spans, least=0.1)) == [(1, 0.0, 3.0), (1, 3.05, 10.0)]
    dur = spark.createDataFrame([(1, 10.0), (2, 4.0), (3, 0.0)], "clip long, dur double")
    assert rows(sequence.clip_windows(dur)) == [(1, 0, 0.0, 6.0), (1, 1, 3.0, 9.0), (1, 2, 6.0, 10.0), (2, 0, 0.0, 4.0), (3, 0, 0.0, 0.0)]
    log = spark.createDataFrame([(1, 1, 1, "pending"), (1, 2, 2, "processing"), (1, 3, 3, "completed"), (1, 4, 4, "processing"), (2, 1, 5, "failed")], "task long, at long, seq long, status string")
    assert [r["legal"] for r in sequence.transitions(log).orderBy("seq").collect()] == [True, True, True, False, False]


def test_merge_by_hand(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    items = [(1, 1, 0.0, 1.0, None), (1, 2, 1.0, 2.0, a), (1, 3, 2.05, 3.0, a), (1, 4, 3.5, 4.0, a), (1, 5, 4.0, 5.0, b), (1, 6, 5.0, 6.0, None), (1, 7, 6.0, 6.001, b), (1, 8, 6.0, 7.0, b)]
    df = spark.createDataFrame(items, "key long, id long, s double, e double, x array<double>")
    placed = merger.merge_items(df)
    want = [(1, None, "no_vector"), (2, 1, "first"), (3, 1, "merged"), (4, 2, "large_gap"), (5, 3, "low_similarity"), (6, 4, "no_vector"), (7, None, "short"), (8, 5, "low_similarity")]
    assert [(r["id"], r["cluster"], r["reason"]) for r in placed.orderBy("id").collect()] == want
    out = {r["name"]: (r["s"], r["e"], r["members"]) for r in merger.clusters(df, placed).collect()}
    assert out["m0001"] == (1.0, 3.0, [2, 3]) and len(out) == 5
    assert {r["name"] for r in merger.centroids(df, placed).collect()} == {"m0001", "m0002", "m0003", "m0005"}
    s = merger.statistics(placed).first()
    assert (s["items"], s["kept"], s["clusters"], s["merged"], s["short"], s["no_vector"]) == (8, 6, 5, 1, 1, 2)


def test_boards(spark):
    rows_ = [("a", "v1", 80.0, 60.0, 40.0, 3), ("a", "v2", 60.0, None, 40.0, 5), ("b", "v1", 70.0, 60.0, 40.0, 4), ("c", "v1", None, 1.0, 1.0, 1)]
    m = boards.model_scores(spark.createDataFrame(rows_, "modelname string, sample_id string, semantic_score double, motion_score double, event_score double, world_score long"))
    top = [(r["rank"], r["modelname"], r["total_score"]) for r in boards.leaderboard(m).collect()]
    assert top == [(1, "a", pytest.approx((70 + 60 + 40 + 80) / 4)), (2, "b", pytest.approx((70 + 60 + 40 + 80) / 4))]
    assert [r["modelname"] for r in boards.leaderboard(m, "world_score").collect()] == ["a", "b", "c"]
    refs = spark.createDataFrame([("v1", "food", "single", 1), ("v2", "food", "multi", 2), ("v3", None, "multi", 3)], "video_id string, theme string, shot_type string, created_at long")
    assert [(r["video_id"], r["theme_display"]) for r in boards.samples_of(refs, "food").collect()] == [("v2", "食物"), ("v1", "食物")]
    assert {r["theme"]: r["n"] for r in boards.theme_statistics(refs).collect()} == {"food": 2, None: 3}
    tasks = spark.createDataFrame([("pending",), ("failed",), ("failed",)], "status string")
    assert tuple(boards.task_statistics(tasks).first()) == (3, 1, 0, 0, 2)


def test_assignment_by_trying_all(spark):
    """Cost of the assignments of small keys against the best of all permutations."""
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(60):
        r, g = (int(x) for x in rng.integers(1, 6, 2))
        score, gate = rng.random((r, g)).round(2), rng.random((r, g)) < 0.6
        n = max(r, g)
        every = [[(i, p[i]) for i in range(r) if p[i] < g] for p in itertools.permutations(range(n))]
        gated = [[(i, j) for i, j in pairs if gate[i, j]] for pairs in every]
        most = max(map(len, gated))
        best = max(sum(score[i, j] for i, j in x) for x in gated if len(x) == most)
        got = assign.padded(score, gate)
        assert len(got) == most and sum(score[i, j] for i, j in got) == pytest.approx(best)
        alone = max(sum(score[i, j] - (2 * 0.6 - 1) for i, j in s) for pairs in every for k in range(len(pairs) + 1) for s in itertools.combinations(pairs, k))
        chosen = assign.dummies(score, 0.6)
        assert all(score[i, j] > 0.6 for i, j in chosen) and sum(score[i, j] - 0.2 for i, j in chosen) <= alone + 1e-9
    frame = [(k, int(i), int(j), float(s), bool(b)) for k in range(300) for (i, j), s, b in zip([(i, j) for i in range(3) for j in range(4)], rng.random(12), rng.random(12) < 0.7, strict=True)]
    got = assign.match(spark.createDataFrame(frame, "key long, ref_id long, gen_id long, score double, gated boolean")).toPandas()
    by = {k: assign.padded(np.array([f[3] for f in frame if f[0] == k]).reshape(3, 4), np.array([f[4] for f in frame if f[0] == k]).reshape(3, 4)) for k in range(300)}
    assert {(r.key, r.ref_id, r.gen_id) for r in got.itertuples()} == {(k, i, j) for k, x in by.items() for i, j in x}


def fold_of(rows, similarity, gap, least):
    """The merge taken one by one, as its definition says it."""
    out, number, upto, centre = [], 0, 0.0, None
    for i, s, e, x in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        vec = None if x is None else np.array(x, float)
        if e - s < least:
            out.append((i, None, "short"))
        elif vec is None and not number:
            out.append((i, None, "no_vector"))
        else:
            near = centre is not None and vec is not None and (centre @ vec / max(np.linalg.norm(centre) * np.linalg.norm(vec), 1e-12) + 1) / 2 >= similarity
            joins = near and max(0.0, s - upto) <= gap
            reason = "no_vector" if vec is None else "first" if not number else "merged" if joins else "large_gap" if near else "low_similarity"
            if joins:
                upto, centre = max(upto, e), centre + (e - s) * vec
            else:
                number, upto, centre = number + 1, e, None if vec is None else (e - s) * vec
            out.append((i, number, reason))
    return out


@pytest.mark.parametrize("bucket", [5.0, 1e9])
def test_merge_of_long_keys_is_the_sequential_fold(spark, bucket):
    """Keys of many pieces, some without any place to cut, with vectors missing at the start and in between."""
    rng = np.random.default_rng(6)
    rows = []
    for key in range(6):
        at = 0.0
        for i in range(300 if key else 3):
            at += float(rng.choice([0.01, 0.3, 2.0], p=[0.6, 0.3, 0.1] if key != 3 else [1.0, 0, 0]))
            x = None if rng.random() < 0.1 or (key == 2 and i < 40) else [float(v) for v in rng.normal(0, 1, 3) + [2, 0, 0]]
            rows.append((key, i, at, at + float(rng.choice([0.0001, 0.2, 1.0])), None if key == 5 else x))
    frame = spark.createDataFrame(rows, "key long, id long, s double, e double, x array<double>").repartition(5)
    got = sorted(map(tuple, merger.merge_items(frame, similarity=0.9, gap=0.1, least=0.002, bucket=bucket).collect()), key=str)
    want = [(k, *r) for k in range(6) for r in fold_of([r[1:] for r in rows if r[0] == k], 0.9, 0.1, 0.002)]
    assert got == sorted(want, key=str)
    reasons = {r[3] for r in want}
    assert reasons == {"short", "no_vector", "first", "merged", "large_gap", "low_similarity"}


def test_one_long_key_is_folded_in_many_tasks(spark):
    n = 60_000
    x = F.array(F.when(F.col("id") % 7 < 5, 1.0).otherwise(-1.0), F.lit(0.5))
    items = spark.range(n).selectExpr("cast(1 as long) as key", "id", "id * 0.5 + (id div 20) * 3.0 as s", "id * 0.5 + (id div 20) * 3.0 + 0.45 as e").withColumn("x", x)
    out = merger.merge_items(items, similarity=0.9, gap=0.1, bucket=500.0)
    stats = merger.statistics(out).first()
    assert stats["items"] == stats["kept"] == n and stats["clusters"] > n // 10
    assert out.agg(F.max("cluster"), F.count_distinct("cluster")).first() == (stats["clusters"], stats["clusters"])


def test_entities_resolve_as_windows_arrive(spark):
    """Windows in shuffled micro-batches give the names that one pass over all of them gives."""
    rng = np.random.default_rng(9)
    rows = []
    for key in range(3):
        for win in range(8):
            for local in range(int(rng.integers(1, 5))):
                at = win * 10.0 + float(rng.random())
                rows.append((key, win, local, str(rng.choice(["cow", "car"])), str(rng.choice(["", "red"])), [str(x) for x in rng.integers(0, 3, 2)], at, at + float(rng.random() * 12)))
    frame = spark.createDataFrame(rows, "key long, win long, local_id long, name string, signature string, attrs array<string>, s double, e double")
    want = entities.resolve(frame)
    log = frame.withColumns({"ts": F.timestamp_seconds(F.col("win") * 10 + 1_000_000), "seq": F.col("local_id")})
    got = stateful.replay(spark, log, stateful.Resolver(), late="1 day", result=stateful.Resolver.RESULT, name="entities", files=3)
    assert sorted((int(r["key"]), r["win"], r["local_id"], r["entity"]) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_folds_of_one_key():
    """The folds alone: a time-out between two changes, one at the end, and a submission that is refused."""
    row = lambda at, **x: (at, at, json.dumps(x))
    machine = stateful.TaskMachine(10.0)
    out, state, wake = machine("k", None, [row(0, status="pending"), row(5_000_000, status="processing"), row(30_000_000, status="completed")], 31_000_000)
    assert [(at, x["status"], x["before"], x["legal"], x["timed_out"]) for at, _, x in out] == [
        (0, "pending", None, True, False), (5_000_000, "processing", "pending", True, False), (15_000_000, "failed", "processing", True, True), (30_000_000, "completed", "failed", False, False)
    ]
    assert wake is None
    out, state, wake = machine("k", None, [row(0, status="pending")], 1)
    assert len(out) == 1 and wake == 10_000_000 and machine("k", state, [], 10_000_001)[0][0][2]["timed_out"]
    guard = stateful.Guard()
    kinds = ["submit", "submit", "failed", "submit", "completed", "submit"]
    out, state, _ = guard("k", None, [row(k, kind=x) for k, x in enumerate(kinds)], 9)
    assert [x["accepted"] for _, _, x in out] == [True, False, False, True, False, False] and state == "completed"


def test_sparse_matching_against_dense():
    """Small matrices with many ties: the total of the dense solver, and prices that prove it."""
    rng = np.random.default_rng(0)
    for _ in range(150):
        r, g = (int(x) for x in rng.integers(1, 8, 2))
        score, gated = np.round(rng.random((r, g)), int(rng.integers(1, 4))), rng.random((r, g)) < 0.5
        i, j = np.nonzero(np.ones((r, g)))
        dense, got = assign.padded(score, gated), assign._chosen(i, j, score.ravel(), gated.ravel(), "event", 0.0)
        assert len(dense) == len(got) and abs(sum(score[x] for x in dense) - sum(x[2] for x in got)) < 1e-9
        assert got == sorted(got, key=lambda x: (-x[2], x[0], x[1]))
        gate = float(rng.choice([0.2, 0.4, 0.6, 0.8]))
        cost = np.full((r + g, r + g), 1 - gate)
        cost[:r, :g], cost[r:, g:] = 1 - score, 0
        taken, u, v = sparse.heaviest(i, j, w := assign._weights(score.ravel(), "dummy", gate, min(r, g)))
        rest = (min(r, g) - taken.sum()) * min(1, 2 * (1 - gate)) + abs(r - g) * (1 - gate)
        assert abs(sum(cost[x, y] for x, y in enumerate(assign.solve(cost))) - (1 - score.ravel()[taken]).sum() - rest) < 1e-9
        assert abs(u.sum() + v.sum() - w[taken].sum()) < 1e-9 and (u[i] + v[j] > w - 1e-9).all() and min(u.min(), v.min()) >= 0


def test_sparse_matching_of_a_long_key():
    """A key of 3,000 by 3,000 items and 60,000 candidates, some of them in parts of their own."""
    rng = np.random.default_rng(1)
    k = np.unique(rng.integers(0, 3000 * 3000, 60_000))
    i, j = k // 3000, k % 3000
    near = (i < 2000) == (j < 2000)
    i, j = i[near], j[near]
    w = rng.random(len(i)) + (rng.random(len(i)) < 0.3)
    taken, u, v = sparse.heaviest(i, j, w)
    assert len(set(i[taken])) == len(set(j[taken])) == taken.sum() > 2900
    assert abs(u.sum() + v.sum() - w[taken].sum()) < 1e-6 and (u[i] + v[j] > w - 1e-9).all()


def test_keys_longer_than_a_batch(spark):
    n = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = [(k, r, g, ((r * 7 + g * 5 + k) % 11) / 11, True) for k in range(5) for r in range(6) for g in range(4)]
        pairs = spark.createDataFrame(frame, "key long, ref_id long, gen_id long, score double, gated boolean")
        proof = assign.certificate(pairs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    assert len(proof) == 5 and all(r["n"] == 4 and r["one_to_one"] and r["feasible"] and abs(r["gap"]) < 1e-9 for r in proof)


def test_similar_blocks(spark, monkeypatch):
    """Best partners and pairs above a threshold, with blocks so small that a key has many; ties, vectors without length, of other sizes and null."""
    rng = np.random.default_rng(3)
    make = lambda n: [(int(k % 2), k, [float(x) for x in np.round(rng.normal(0, 1, 20) + 2 * (k % 3), 1)]) for k in range(n)]
    left, right = make(60), make(50)
    right += [(0, 100, right[4][2]), (0, 101, [0.0] * 20), (0, 102, None), (1, 103, [1.0] * 3), (7, 104, right[1][2]), (0, None, right[4][2]), (0, 105, [None] + [1.0] * 19)]
    frames = [spark.createDataFrame(t, "key long, id long, x array<double>") for t in (left, right)]
    monkeypatch.setattr(similar, "BLOCK", 16)
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    usable = [(k, i, x) for k, i, x in right if i is not None and x is not None and None not in x and any(x)]
    cos = {(k, i, j): float(unit(x) @ unit(y)) for k, i, x in left for q, j, y in usable if k == q and len(x) == len(y)}
    got = {(r["key"], r["left_id"], r["right_id"]): r["cosine"] for r in similar.pairs_above(*frames, 0.8).collect()}
    assert set(got) == {p for p, c in cos.items() if c >= 0.8} and all(abs(got[p] - cos[p]) < 1e-12 for p in got)
    want = set()
    for k, i, _ in left:
        order = sorted((-round(c, 6), j) for (q, a, j), c in cos.items() if (q, a) == (k, i))
        want |= {(k, i, j, n) for n, (_, j) in enumerate(order[:3], 1)}
    assert {(r["key"], r["left_id"], r["right_id"], r["rank"]) for r in similar.best_within(*frames, 3).collect()} == want
    seen = []
    a, b = (rng.normal(0, 1, (300, 64)) * np.where(np.arange(64) < 16, 4, 0.3) for _ in range(2))
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    assert len(similar.above(a, b, 0.8, seen)[0]) == int((a @ b.T >= 0.8).sum()) and seen[0] < 300 * 300 / 2


def test_pooled_vectors(spark):
    rows = [("a", 2.0, [3.0, 0.0]), ("a", 1.0, [0.0, 8.0]), ("a", -1.0, [5.0, 5.0]), ("a", None, [1.0, 1.0]), ("b", 1.0, [1.0]), ("b", 1.0, [0.0, 1.0]), ("c", 1.0, [0.0, 0.0]), ("c", 1.0, None), ("d", 1.0, [None, 1.0]), (None, 1.0, [0.0, 2.0])]
    frame = spark.createDataFrame(rows * 3, "key string, w double, x array<double>").repartition(4)
    got = {r["key"]: r["x"] for r in pooling.pooled(frame).collect()}
    half = 0.5**0.5
    assert got.keys() == {"a", "b", "c", None} and got["c"] is None and got[None] == [0.0, 1.0]
    assert np.allclose(got["a"], [0.6, 0.8]) and np.allclose(got["b"], [half, half])


def peaks_of(x, height, distance, prominence):
    top = [k for k in range(1, len(x) - 1) if x[k - 1] < x[k] >= x[k + 1] and x[k] >= height]
    keep = dict.fromkeys(top, True)
    for k in sorted(top, key=lambda k: (-x[k], -k)):
        if keep[k]:
            keep |= {j: False for j in top if j != k and abs(j - k) < distance}
    out = []
    for k in (k for k in top if keep[k]):
        sides = []
        for step in (-1, 1):
            j, low = k + step, x[k]
            while 0 <= j < len(x) and x[j] <= x[k]:
                low, j = min(low, x[j]), j + step
            sides.append(low)
        if x[k] - max(sides) >= prominence:
            out.append(k)
    return out


@pytest.mark.parametrize("chunk", [7, 50, 65_536])
def test_peaks_in_chunks(spark, chunk):
    """Chunks so small that valleys reach over many of them, ties, slopes, a flat series and one of two places."""
    rng = np.random.default_rng(5)
    series = {1: np.round(rng.normal(0, 3, 300).cumsum()), 2: np.round(rng.random(200) * 6), 3: np.arange(90.0), 4: np.ones(30), 5: np.array([1.0, 2.0]), 6: np.abs(np.arange(150.0) - 75) * -1}
    rows = [(k, 3 * t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [(1, None, 9.0), (None, 4, 9.0), (2, 601, None)]
    frame = spark.createDataFrame(rows, "key long, t long, x double").repartition(4)
    for height, distance, prominence in ((-20.0, 3, 2.0), (2.0, 1, 0.0), (-1e9, 20, 5.0)):
        got = sorted(map(tuple, peaks.spaced_peaks(frame, height=height, distance=distance, prominence=prominence, bucket=64, chunk=chunk).select("key", "t").collect()))
        assert got == sorted((k, 3 * t) for k, x in series.items() for t in peaks_of(x, height, distance, prominence))


def test_exact_quantiles(spark):
    """Large groups by histograms, small ones by Spark's percentile: heavy ties, one value, far values, nulls and values that are no numbers."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0, 1, 3000), "b": np.r_[np.zeros(2000), rng.random(50), -1e300, 1e300], "c": np.full(700, 5.0), "d": np.array([1.0, 4.0]), None: np.exp(rng.normal(0, 30, 500)), "e": np.array([7.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("b", float("inf")), ("f", None)]
    frame = spark.createDataFrame(rows, "name string, v double").repartition(5)
    ps = [0.0, 0.25, 0.5, 0.95, 1.0]
    for limit in (100, 10_000):
        got = {(r["key"], r["p"]): r["quantile"] for r in quantiles.exact_quantiles(frame, "name", "v", ps, limit=limit).collect()}
        assert got.keys() == {(k, p) for k in groups for p in ps}
        for (k, p), q in got.items():
            assert np.isclose(q, np.quantile(groups[k], p), rtol=1e-12, atol=1e-12), (k, p)


def test_similar_sets(spark):
    rng = np.random.default_rng(4)
    sets = {k: set(rng.choice([f"m{x}" for x in range(30)], int(rng.integers(1, 12))).tolist()) for k in range(120)} | {200: {"all"}, 201: {"all"}, 202: set()}
    members = [(k, m) for k, s in sets.items() for m in s] + [(0, m) for m in sets[0]] + [(None, "m1"), (5, None)]
    frame = spark.createDataFrame(members, "id long, member string")
    for least in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        got = set_join.similar_sets(frame, least).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
        assert all(abs(r["jaccard"] - len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]])) < 1e-12 for r in got)


def test_cache_by_content(spark, tmp_path):
    """The second run works on new texts alone, another configuration on all, and a purpose and a text never run together."""
    asked = []

    def work(missing):
        asked.append(sorted(r["text"] for r in missing.collect()))
        return missing.select("key", F.array(F.length("text").cast("double")).alias("result"))

    run = lambda texts, config: {tuple(r)[:2]: (r["result"], r["fresh"]) for r in cache.with_cached(spark.createDataFrame(texts, "purpose string, text string"), work, f"{tmp_path}/store", config=config).collect()}
    first = run([("q", "one"), ("q", "one"), ("p", "one"), ("q", None)], "v1")
    assert first == {("q", "one"): ([3.0], True), ("p", "one"): ([3.0], True), ("q", None): (None, False)}
    second = run([("q", "one"), ("q", "three"), ("qo", "ne"), (None, "one")], "v1")
    assert second == {("q", "one"): ([3.0], False), ("q", "three"): ([5.0], True), ("qo", "ne"): ([2.0], True), (None, "one"): ([3.0], True)}
    run([("q", "one")], "v2")
    run([("q", "one"), ("q", "three")], "v1")
    assert asked == [["one", "one"], ["ne", "one", "three"], ["one"], []]
    cache.compacted(spark, f"{tmp_path}/store", f"{tmp_path}/small", files=1)
    assert spark.read.parquet(f"{tmp_path}/small/results").count() == 6


def test_table_functions(spark):
    table_functions.register(spark)
    got = spark.sql("select m.* from values ('a', 'one. two | '), ('b', null), ('c', '') t(id, x), lateral micro_events(id, x) m").collect()
    assert sorted(tuple(r) for r in got) == [("a#1", "a", 1, "one"), ("a#2", "a", 2, "two")]
    got = spark.sql("select n, w.* from values (0.0D), (7.0D), (12.0D), (null) t(n), lateral clip_windows(n, 6.0D, 3.0D) w").collect()
    assert sorted(tuple(r) for r in got) == [(0.0, 0, 0.0, 0.0), (7.0, 0, 0.0, 6.0), (7.0, 1, 3.0, 7.0), (12.0, 0, 0.0, 6.0), (12.0, 1, 3.0, 9.0), (12.0, 2, 6.0, 12.0)]
    with pytest.raises(Exception, match="hop must be over 0"):
        spark.sql("select * from clip_windows(7.0D, 6.0D, 0.0D)").collect()
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("select * from micro_events('a', 3)").collect()
