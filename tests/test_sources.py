"""Readers and writers on small files: broken ones, other encodings, aliases, repeated keys."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipweave.functions import evidence as ev
from clipweave.functions import scores as sc
from clipweave.sources import event_board, files, readers, writers
from clipweave.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)


def test_events_and_broken_files(spark, tmp_path):
    put(tmp_path / "a_001_single.newevents.json", json.dumps([{"id": "m0001", "s": 0.1, "e": 0.5, "s_abs": 1, "e_abs": 5, "emb": [3, 4]}, {"eid": "m0002", "s": 0.5, "e": 0.9, "vec": [0, 0]}]))
    put(tmp_path / "b.json", json.dumps({"events": [{"event_id": "e0001#2", "parent_id": "e0001", "text": "two"}, {"id": "e0001#1", "text": "one", "embedding": [1, 0]}]}))
    put(tmp_path / "c.json", '{"events": [')
    put(tmp_path / "d.json", " \n")
    got = readers.read_events(spark, str(tmp_path))
    assert sorted((r["sample_id"], r["id"]) for r in got.collect()) == [("a_001_single", "m0001"), ("a_001_single", "m0002"), ("b", "e0001#1"), ("b", "e0001#2")]
    bad = {r["path"].rsplit("/", 1)[1]: r["error"] for r in readers.broken_files(spark, str(tmp_path)).collect()}
    assert set(bad) == {"c.json", "d.json"} and bad["d.json"] == "empty file" and "not JSON" in bad["c.json"]
    unit = {r["id"]: r["emb"] for r in readers.unit_vectors(got).collect()}
    assert unit["m0001"] == pytest.approx([0.6, 0.8]) and unit["m0002"] is None
    assert rows(readers.are_micro(got)) == [("a_001_single", False), ("b", True)]
    assert rows(readers.event_texts(got)) == [("b", "e0001", "one | two")]
    assert ("a_001_single", "m0001", 1.0, 5.0) in rows(readers.span_map(got)) and ("a_001_single", "m0002", 0.5, 0.9) in rows(readers.span_map(got))


def test_samples_scenes_prompts(spark, tmp_path):
    put(tmp_path / "m.jsonl", '{"sample_id": "x", "theme": "food", "prompt": "p"}\n{"id": "y", "topic": "landscape", "theme": "food"}\n{broken\n{"theme": "food"}\n')
    assert rows(readers.read_samples(spark, str(tmp_path / "m.jsonl")).select("sample_id", "theme")) == [("x", "food"), ("y", "landscape")]
    assert rows(readers.read_samples(spark, str(tmp_path / "m.jsonl"), ["food"]).select("sample_id")) == [("x",)]
    put(tmp_path / "s" / "v1.json", "[[0, 1.5], [1.5, 4], [7]]")
    assert rows(readers.read_scenes(spark, str(tmp_path / "s"))) == [("v1", 0, 0.0, 1.5), ("v1", 1, 1.5, 4.0)]
    put(tmp_path / "p" / "food" / "food_001_multi.txt", "  a pan \n")
    put(tmp_path / "p" / "food" / "food_002.txt", "b")
    put(tmp_path / "p" / "food" / "empty_single.txt", " \n")
    assert rows(readers.read_prompts(spark, str(tmp_path / "p" / "food"))) == [("food_001_multi", "food", "multi", "a pan"), ("food_002", "food", "single", "b")]


def test_csv_of_any_encoding(spark, tmp_path):
    put(tmp_path / "a.csv", "\ufeff模型,sample,score\nm1,v1.mp4,7%\n")
    put(tmp_path / "b.csv", "模型,sample,S_event\n模二,v2,81.5\n", "gbk")
    t = readers.read_csv_any(spark, str(tmp_path))
    got = readers.read_scores(t, ("event_score",))
    assert rows(got) == [("m1", "v1", 7.0), ("模二", "v2", 81.5)]


def test_indexes(spark):
    files = spark.createDataFrame([("/a/Clip_prompt.mp4",), ("/b/clip.MOV",), ("/b/notes.txt",)], "path string")
    assert rows(readers.video_index(files)) == [("clip", "/b/clip.MOV")]
    banks = spark.createDataFrame([("/k/one_scored.json", "/v/clip.mp4"), ("/k/two_scord.json", "/v/one.mp4"), ("/k/three_scord.json", None)], "path string, video string")
    assert rows(readers.bank_index(banks)) == [("clip", "/k/one_scored.json"), ("one", "/k/one_scored.json"), ("three", "/k/three_scord.json"), ("two", "/k/two_scord.json")]


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([("m1", "a", 1 / 3), ("m2", "b", None)], "modelname string, sample_id string, s double")
    writers.append_scores(t, str(tmp_path / "s"), ["s"])
    writers.append_scores(t.where("modelname = 'm1'"), str(tmp_path / "s"), ["s"])
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert sorted((r["modelname"], r["s"] or "") for r in back.collect()) == [("m1", "0.333333"), ("m1", "0.333333"), ("m2", "")]
    assert rows(writers.done_keys(spark, str(tmp_path / "s"), ["modelname", "sample_id"])) == [("m1", "a"), ("m2", "b")]
    writers.write_boards(t, str(tmp_path / "b"), ["s"])
    assert spark.read.option("header", True).csv(str(tmp_path / "b" / "models")).count() == 2
    st = writers.with_status(t, missing="s is null", error="s < 0", reused="sample_id = 'a'")
    assert rows(st.select("sample_id", "status")) == [("a", "reused"), ("b", "missing")]
    writers.write_reports(st, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    old = spark.createDataFrame([("m1", "a", 9.0, "x")], "modelname string, sample_id string, s double, note string")
    merged = writers.merge_chunks(old, t, ["modelname", "sample_id"])
    assert rows(merged.select("sample_id", "s", "note")) == [("a", 9.0, "x"), ("b", None, None)]
    left = writers.cascade({"t": t, "old": old}, t.where("modelname = 'm1'"), ["modelname"])
    assert left["t"].count() == 1 and left["old"].count() == 0


def test_newest_versions(spark):
    v = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("a", 2, 1)], "k string, n long, batch long")
    assert rows(jobs.newest(v, ["k"])) == [("a", 2), ("b", 1)]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from clipweave import session

    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        session.shared_dir(Far())


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    frame = spark.range(1).select(*(v.alias(n) for n, v in zip(names, values, strict=True)))
    return frame.select(column(*(F.col(n) for n in names)).alias("x")).first()["x"]


def test_evidence_functions(spark):
    span = lambda *s: F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in s))
    rel = lambda s, o: one(spark, lambda a, b: ev.relation_spans(a, b, F.lit(0.0), F.lit(10.0), 1.0), s, o)
    assert rel(span((0, 4)), span((2, 8))) == [[2.0, 4.0]]
    assert rel(span((0, 2.2)), span((2, 8))) == [[1.6, 2.6]]  # too short: a window about its middle
    assert rel(span((0, 2)), span((5, 8), (3, 4))) == [[2.0, 3.0]]  # apart: about the nearest gap
    assert rel(span((0, 3), (3.1, 6)), span((1, 9))) == [[1.0, 6.0]]  # touching parts are one
    assert one(spark, ev.merged_spans, span((3, 4), (0, 1), (1.1, 2))) == [[0.0, 2.0], [3.0, 4.0]]
    assert one(spark, ev.coerced_spans, F.lit("[[1,2],[3],[4,5,6]]")) == [[1.0, 2.0], [4.0, 5.0]] and one(spark, ev.coerced_spans, F.lit("7")) == []
    assert one(spark, lambda c: ev.nfc(c), F.lit("e\u0301 x")) == "\u00e9 x"
    assert one(spark, ev.canonical_name, F.lit(" Bull ")) == "cow" and one(spark, lambda n: ev.display_name(n, F.lit(9)), F.lit("men")) == "person"
    j = one(spark, lambda c: ev.judged(c, False), F.lit('```json\n{"answer": "two dogs", "consistency": "88"}\n```'))
    assert (j["answer"], j["consistency"]) == ("two dogs", 88)
    assert tuple(one(spark, lambda c: ev.judged(c, True), F.lit("I say 101 or 42."))) == ("", 42) and tuple(one(spark, lambda c: ev.judged(c, True), F.lit(None).cast("string"))) == ("", 0)
    e = one(spark, ev.event_list, F.lit('{"x": 1, "spans": [{"id": "a", "enabled": false}, {"id": "b", "valid": false}, {"id": "c"}]}'))
    assert [r.toPython()["id"] for r in e] == ["a", "b", "c"] and one(spark, lambda c: ev.enabled_count(ev.event_list(c)), F.lit('[{"id": "a"}]')) == 1
    m = one(spark, ev.normal_attributes, F.expr("array(struct('Color' as key, array(' Red!', 'red', '#', '7') as values), struct('color' as key, array('blue') as values), struct('number-or-id' as key, array('37', '137') as values))"))
    assert m == {"color": ["blue"], "number-or-id": ["137"]}


def test_scores_from_json(spark):
    scores = lambda x: one(spark, sc.event_scores, F.lit(x).cast("string"))
    ega = lambda x: scores(json.dumps({"EGA": x, "ERel": 1, "ECR": 1, "S_event": 1}))
    assert ega({"a": {"b": "x", "c": {"mean": 3}}})["ega"] == 3.0 and ega({"value": "x"}) is None and ega([1]) is None
    assert ega({"z": 9, "summary": {"q": 4}})["ega"] == 4.0 and ega({"z": 9, "avg": 5})["ega"] == 5.0 and ega(True)["ega"] == 1.0 and ega({"avg": "5", "z": 9, "a": 2})["ega"] == 9.0
    doc = {"summary": {"EGA": {"score": 80}, "erel": {"valid": False, "S": 0}}, "ECR (f1)": 50, "s_event": {"final": 56}}
    assert scores(json.dumps(doc)).asDict() == {"ega": 80.0, "erel": 0.0, "ecr": 50.0, "s_event": 56.0, "erel_valid": False}
    assert scores('{"EGA": 1}') is None and scores("[1]") is None and scores(None) is None and scores("{'EGA': 1}") is None
    number = lambda x, *prefer: one(spark, lambda c: sc.picked_number(c, prefer), F.lit(json.dumps(x)))
    assert number({"S": "n/a", "rows": [{"band": "4"}]}, "S") == 4.0 and number({"a": [{}]}, "S") is None and number({"x": {"score": 1}, "b": {"S": 2}, "my_score": 3}, "S") == 3.0


def test_event_lists_at_any_depth(spark, tmp_path):
    """The layouts of event files: under ``events``, under other keys however deep, or the list itself."""
    docs = {
        "plain": {"events": [{"id": 1}, {"id": 2, "enabled": False}]}, "deep": {"a": {"list": [{"id": 1}, {"id": 2, "valid": 0}, {"id": 3, "enabled": "false"}]}}, "top": [{"id": 1}, 7, {"enabled": None}],
        "numbers": {"ids": [1, 2], "x": {"y": [3, {"id": 1}]}}, "late": {"n": [1, 2, 3, 4, 5, {"id": 1}]}, "hidden": {"a": [{"id": 1}], "events": []}, "passed": {"a": {"events": [], "b": [{"id": 1}]}, "c": [{"id": 2}, {"id": 3}]},
        "none": {"events": {"a": 1}}, "lists": {"a": [[{"id": 1}]]},
    }
    for name, doc in docs.items():
        put(tmp_path / f"{name}.newevents.json", json.dumps(doc))
    put(tmp_path / "broken.json", "{")
    got = {r["sample_id"]: (r["total"], r["enabled"]) for r in readers.read_event_lists(spark, str(tmp_path)).collect()}
    assert got == {"plain": (2, 1), "deep": (3, 2), "top": (3, 2), "numbers": (2, 2), "late": (0, 0), "hidden": (0, 0), "passed": (2, 2), "none": (0, 0), "lists": (0, 0), "broken": (0, 0)}
    merged = dict(map(tuple, readers.read_merged_counts(spark, str(tmp_path)).collect()))
    assert merged == {"plain": "2", "top": "3", "hidden": "0"} | dict.fromkeys(("deep", "numbers", "late", "passed", "none", "lists", "broken"), "")


def test_scene_layouts(spark, tmp_path):
    put(tmp_path / "v1.json", '{"scenes": [[0, 1.5], [1.5, 4]], "fps": 25}')
    put(tmp_path / "v2.json", "[[0, 2], [3], [2, 5, 9]]")
    put(tmp_path / "v3.json", '{"shots": [[0, 2]]}')
    put(tmp_path / "v4.json", '[[0, "x"]]')
    put(tmp_path / "v5.json", "[[0, 1")
    assert rows(readers.read_scenes(spark, str(tmp_path))) == [("v1", 0, 0.0, 1.5), ("v1", 1, 1.5, 4.0), ("v2", 0, 0.0, 2.0), ("v2", 2, 2.0, 5.0)]
    bad = {r["path"][-7:-5]: r["error"] for r in readers.broken_scenes(spark, str(tmp_path)).collect()}
    assert bad.keys() == {"v2", "v3", "v4", "v5"} and bad["v3"] == "no list of scenes" and bad["v5"].startswith("not JSON")


def test_reports_and_fallback_scores(spark, tmp_path):
    base = tmp_path / "event" / "scores"
    put(base / "m1" / "a__m1" / "scores.json", json.dumps({"EGA": 1, "ERel": {"valid": True, "S": 2}, "ECR": 3, "S_event": 4, "score": 9}))
    put(base / "m1" / "b.mp4__m1" / "scores.json", json.dumps({"rows": [{"final_score": "61"}]}))
    put(base / "m1" / "c__m1" / "scores.json", json.dumps({"note": "none"}))
    found = readers.fallback_scores(spark, str(base / "*" / "*" / "scores.json"))
    assert rows(found) == [("m1", "a", 9.0), ("m1", "b", 61.0)]
    assert rows(readers.read_event_reports(spark, str(base / "*" / "*" / "scores.json")).select("ega", "erel", "ecr", "s_event", "erel_valid")) == [(1.0, 2.0, 3.0, 4.0, True)]
    table = spark.createDataFrame([("m1", "a", 77.0), ("m1", "b", None)], "modelname string, sample_id string, event_score double")
    assert rows(readers.merge_scores([table], found)) == [("m1", "a", 77.0), ("m1", "b", 61.0)]


def test_feature_files(spark, tmp_path):
    np.savez(tmp_path / "a 1.npz", hof=np.arange(6.0).reshape(2, 3), phi=np.array([1, 2]))
    np.savez(tmp_path / "b.npz", hof=np.zeros(0), phi=np.array(["x"]))
    np.savez(tmp_path / "c.npz", hof=np.zeros(1))
    (tmp_path / "d.npz").write_bytes(b"PK nothing")
    got = {(r["sample_id"], r["name"]): (r["shape"], r["values"], r["error"]) for r in files.read_features(spark, str(tmp_path), required=("hof", "phi")).collect()}
    assert got["a 1", "hof"] == ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], None) and got["a 1", "phi"] == ([2], [1.0, 2.0], None) and got["b", "hof"] == ([0], [], None)
    assert got["b", "phi"][2].startswith("no numbers") and got["c", None][2] == "missing: phi" and got["d", None][2].startswith("no arrays")
    assert {r["sample_id"] for r in files.read_features(spark, str(tmp_path), sample="b").collect()} == {"b"}


def test_csv_of_many_files(spark, tmp_path):
    put(tmp_path / "a.csv", 'x,y\n1,"two\nlines"\n\n3\n')
    put(tmp_path / "b.csv", "\ufeffy,名称\nq,\n")
    put(tmp_path / "c.csv", "名称\n值\n", "gbk")
    (tmp_path / "d.csv").write_bytes(b"")
    got = readers.read_csv_any(spark, str(tmp_path))
    assert got.columns == ["x", "y", "名称"] and rows(got) == sorted([("1", "two\nlines", None), ("3", None, None), (None, "q", None), (None, None, "值")], key=str)


def test_from_event_folders_to_the_board(spark, tmp_path):
    """A perfect copy, one with an event too many, one that is unlike, and a sample without a reference."""
    event = lambda k, s, e, x, y: {"id": f"e{k}", "s": s / 10, "e": e / 10, "s_abs": s, "e_abs": e, "emb": [x, y]}
    two = [event(1, 0, 4, 1, 0), event(2, 4, 10, 0, 1)]
    put(tmp_path / "ref" / "a.newevents.json", json.dumps({"events": two}))
    put(tmp_path / "ref" / "b.events.json", json.dumps(two[:1]))
    put(tmp_path / "gen" / "a__m1.events.json", json.dumps(two))
    put(tmp_path / "gen" / "b__m1.events.json", json.dumps([*two[:1], event(7, 5, 6, 0, 1)]))
    put(tmp_path / "gen" / "a__m2.events.json", json.dumps([event(1, 0, 10, -1, 0)]))
    put(tmp_path / "gen" / "c__m2.events.json", json.dumps(two))
    got = {(r["modelname"], r["sample_id"]): r for r in event_board.run_event_board(spark, str(tmp_path / "ref"), str(tmp_path / "gen"), str(tmp_path / "out")).collect()}
    assert got.keys() == {("m1", "a"), ("m1", "b"), ("m2", "a")}
    best, more, none = got["m1", "a"], got["m1", "b"], got["m2", "a"]
    assert [best[c] for c in event_board.SCORES] == pytest.approx([100, 100, 100, 100])
    assert more["erel"] is None and more["ega"] == pytest.approx(100) and more["ecr"] == pytest.approx(200 * 0.5 / 1.5)
    assert none["ega"] is None and none["ecr"] == 0 and none["s_event"] == 0
    models = spark.read.option("header", True).csv(str(tmp_path / "out" / "models"))
    assert {r["modelname"]: r["count_sample_id"] for r in models.collect()} == {"m1": "2", "m2": "1"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "scores")).count() == 3


def test_frames_without_rows(spark):
    empty = pd.DataFrame({"user": pd.Series(dtype="int64")})
    assert spark.createDataFrame(empty, "user long").count() == 0
