"""Each operator against brute force on small texts: nulls, empties, ties, repeated rows, extra columns, empty tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from clipweave.llm import bwt_merge, catalog, components, line_dedup, mixing, ngram_join, pieces, quality_rules, quotation, rans, repeats, suffix_tree, topk

from ..conftest import SF, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, BPE = catalog.tokenizer_path("piece_bpe_32k.model"), catalog.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = ["a", "Be", "cé", "ß", "the", "#x", "42", "naïve", "日本"]
    base = [" ".join(rng.choice(vocab, 150)) for _ in range(6)]
    out = {}
    for i in range(40):
        b = base[int(rng.integers(6))]
        cut = int(rng.integers(0, 60))
        words = b.split(" ")[cut : cut + int(rng.integers(5, 100))]
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = "edit"
        out[i] = str(rng.choice(["\n", " ", "\t"])).join(words)
    long = " ".join(rng.choice(vocab, 4000))
    return out | {40: None, 41: "", 42: " \n\t ", 43: "one two", 44: "ONE two", 45: out[3], 46: out[3], 47: long, 48: long + " tail", 49: "x" * 3000}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "de" if i % 3 else "en", f"s{i % 5}", i, "clash") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def removed(seqs, width):
    first = {}
    for d in sorted(seqs):
        for k in range(len(seqs[d]) - width + 1):
            first.setdefault(seqs[d][k : k + width], d)
    out = {}
    for d, s in seqs.items():
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            if first[s[k : k + width]] < d:
                gone[k : k + width] = [True] * width
        out[d] = gone
    return out


@pytest.mark.parametrize("width", [5, 20, 50])
def test_suffix_tree(docs, texts, width):
    seqs = {d: tuple(WORD.findall(t or "")) for d, t in texts.items()}
    gone = removed(seqs, width)
    for r in suffix_tree.remove_repeated_words(docs, width=width).collect():
        kept = " ".join(w for w, g in zip(seqs[r["doc_id"]], gone[r["doc_id"]]) if not g)
        assert (r["n_units"], r["n_removed"], bytes(r["kept"]).decode(), r["kept_sha256"]) == (len(seqs[r["doc_id"]]), sum(gone[r["doc_id"]]), kept, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("width", [7, 50])
def test_bwt_merge(docs, texts, width, monkeypatch):
    seqs = {d: (t or "").encode() for d, t in texts.items()}
    gone = removed(seqs, width)
    for r in bwt_merge.remove_repeated_bytes(docs, width=width).collect():
        g = gone[r["doc_id"]]
        assert bytes(r["kept"]) == bytes(b for b, x in zip(seqs[r["doc_id"]], g) if not x)
        assert (r["n_units"], r["n_removed"], r["n_spans"]) == (len(g), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])))


def test_repeats_edges(spark, docs, empty):
    assert suffix_tree.remove_repeated_words(empty).count() == 0 and bwt_merge.remove_repeated_bytes(empty).count() == 0
    twice = spark.createDataFrame([(1, "q w e r t y u i o p " * 9), (1, "q w e r t y u i o p " * 9), (None, "x"), (2, "q w e r t y u i o p " * 9)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_tree.remove_repeated_words(twice).collect())
    assert got == [(1, 0), (1, 0), (2, 90)]


@pytest.mark.parametrize(("big", "limit"), [(3, 1 << 20), (10**6, 1 << 20), (10**6, 150), (3, 60), (10**6, 1)])
def test_repeats_of_a_common_passage(spark, big, limit):
    """One passage in all documents, copies and cuts of it among them: many equal segments in a slice, others at its edges; keys too large for a task."""
    rng = np.random.default_rng(12)
    passage = [f"p{k}" for k in range(70)]
    texts = {}
    for k in range(260):
        a, b = sorted(rng.integers(0, 71, 2)) if k % 7 == 0 else (0, 70)
        own = [f"d{int(x)}" for x in rng.integers(0, 40, int(rng.integers(0, 30)))]
        texts[k] = " ".join(own + passage[a:b] + [f"e{int(x)}" for x in rng.integers(0, 40, int(rng.integers(0, 30)))])
    texts |= {300: texts[5], 301: texts[5], 302: None, 303: " ".join(passage * 3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    words = {d: tuple(WORD.findall(t or "")) for d, t in texts.items()}
    gone = removed(words, 20)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_tree.remove_repeated_words(docs, width=20, kept=False, big=big, limit=limit).collect()}
    assert got == {d: sum(g) for d, g in gone.items()}
    raw = {d: (t or "").encode() for d, t in texts.items()}
    gone = removed(raw, 50)
    got = {r["doc_id"]: r["n_removed"] for r in bwt_merge.remove_repeated_bytes(docs, kept=False, big=big, limit=limit).collect()}
    assert got == {d: sum(g) for d, g in gone.items()}


@pytest.mark.parametrize("kind", [suffix_tree.word_units(12), bwt_merge.byte_units(50)])
def test_pieces_keep_equal_windows_together(kind):
    """Windows are dealt to pieces once each, equal ones by one key, and deals of longer keys end with single windows."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 9, 400)
    texts = [np.r_[rng.integers(0, 9, int(rng.integers(0, 60))), common[a : a + 150], rng.integers(0, 9, int(rng.integers(0, 60)))] for a in rng.integers(0, 250, 30)]
    units, before = np.concatenate(texts).astype(kind.dtype), np.r_[0, np.cumsum([len(t) for t in texts])]
    row, at, many, _, place = repeats.runs(units, before, kind)
    windows = np.sort(np.concatenate([np.arange(a, a + n) for a, n in zip(at, many)]))
    sizes = []
    for level in repeats.levels(kind.width):
        run, first, n, key = repeats.pieces(units, at, many, place, level)
        assert n.max() <= level[0] and (row[run] == np.searchsorted(before, first, side="right") - 1).all()
        spread = np.concatenate([np.arange(a, a + m) for a, m in zip(first, n)])
        assert (np.sort(spread) == windows).all()
        keys, segments = {}, {}
        for a, m, k in zip(first.tolist(), n.tolist(), key.tolist()):
            segments.setdefault(k, set()).add(units[a : a + m + kind.width - 1].tobytes())
            for w in range(a, a + m):
                assert keys.setdefault(units[w : w + kind.width].tobytes(), k) == k
        sizes.append(max(map(len, segments.values())))
    assert sizes[-1] == 1 and sizes == sorted(sizes, reverse=True)


def test_segments_of_one_anchor_in_bounded_memory():
    """Many distinct segments of one key: the structure never sees more units than twice the limit, and what is passed on goes through it later."""
    kind, limit, rng = suffix_tree.word_units(50), 20_000, np.random.default_rng(4)
    middle = np.arange(1000, 1045, dtype=np.uint64)
    texts = [np.r_[rng.integers(0, 3, 30).astype(np.uint64), middle, rng.integers(0, 3, 30).astype(np.uint64)] for _ in range(3000)]
    units, before = np.concatenate(texts), np.arange(3001) * 105
    row, at, many, anchor, _ = repeats.runs(units, before, kind)
    docs = row + 1
    seen, rounds = [], 0

    def least(segments, smallest, width):
        seen.append(sum(map(len, segments)))
        return suffix_tree.least_documents(segments, smallest, width)

    def in_groups(table):
        return table.filter(pc.is_valid(table["kind"])).sort_by([("kind", "ascending"), ("g", "ascending")])

    todo = in_groups(pa.Table.from_batches([repeats._dealt(kind, 7, units, at, many, anchor, docs, docs, at - before[row])]))
    got = np.zeros(len(units), bool)
    for finer in (*repeats.levels(50), None):
        rounds += 1
        found = pa.Table.from_batches(repeats._found(kind, least, 7, finer, limit)(iter(todo.to_batches())))
        for r in found.to_pylist():
            if r["runs"] is not None:
                for start, n in np.frombuffer(r["runs"], np.int64).reshape(-1, 2):
                    got[before[r["doc_id"] - 1] + start :][:n] = True
        todo = in_groups(found)
        if not len(todo):
            break
    first, want = {}, np.zeros(len(units), bool)
    for d in range(3000):
        for k in range(56):
            w = units[before[d] + k : before[d] + k + 50].tobytes()
            want[before[d] + k] = first.setdefault(w, d) < d
    assert (got == want).all() and rounds > 1 and max(seen) <= 2 * limit


def structures(module, make, rng):
    for _ in range(40):
        width, base = int(rng.integers(2, 12)), rng.integers(97, 97 + int(rng.integers(1, 5)), 300)
        segs = {}
        for _ in range(int(rng.integers(1, 40))):
            a, n = int(rng.integers(0, 200)), int(rng.integers(width, width + 40))
            x = base[a : a + n].copy()
            if rng.random() < 0.5:
                x[rng.integers(0, len(x))] = 98
            segs[x.tobytes()] = make(x)
        segs = list(segs.values())
        small = rng.integers(0, 50, len(segs)).astype(np.int64)
        least = {}
        for s, m in zip(segs, small):
            for k in range(len(s) - width + 1):
                w = s[k : k + width].tobytes()
                least[w] = min(least.get(w, 99), m)
        want = [least[s[k : k + width].tobytes()] for s in segs for k in range(len(s) - width + 1)]
        assert module.least_documents(segs, small, width).tolist() == want


def test_structures_small_groups(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(bwt_merge, "SHARD", 90)
    monkeypatch.setattr(suffix_tree, "SUBTREE", 9)
    structures(bwt_merge, lambda x: x.astype(np.uint8), rng)
    structures(suffix_tree, lambda x: x.astype(np.uint64), rng)


def test_bwt_merge_of_many_shards(monkeypatch):
    """More shards than eight bits can number."""
    monkeypatch.setattr(bwt_merge, "SHARD", 20)
    rng = np.random.default_rng(5)
    segs = [np.frombuffer(x, np.uint8) for x in sorted({rng.integers(97, 100, 12).astype(np.uint8).tobytes() for _ in range(700)})]
    small = rng.integers(0, 1000, len(segs)).astype(np.int64)
    windows, least = [s[k : k + 6].tobytes() for s in segs for k in range(7)], {}
    for w, m in zip(windows, np.repeat(small, 7)):
        least[w] = min(least.get(w, 1000), m)
    assert len(segs) > 300
    assert bwt_merge.least_documents(segs, small, 6).tolist() == [least[w] for w in windows]


def jaccard_sets(texts):
    out = {}
    for d, t in texts.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        out[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def linked(sets, percent=80):
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {d: top(d) for d in sets}


def test_ngram_join(spark, docs, texts, empty):
    sets = jaccard_sets(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    want = linked(sets)
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, hot=2).collect()} == want
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_join_near_the_limit(spark):
    rng = np.random.default_rng(5)
    texts, k = {}, 0
    for n in (6, 9, 14, 30, 80, 200):
        for _ in range(4):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            texts[k] = " ".join(words)
            for _ in range(6):  # tails that bring the similarity close to 0.8 from both sides
                k += 1
                texts[k] = " ".join(words + [f"t{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, n // 3 + 2)))])
            k += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = linked(jaccard_sets(texts))
    for hot in (ngram_join.HOT, 2):
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, hot=hot).collect()} == want


def test_ngram_join_many_near_copies(spark, monkeypatch):
    """Near copies of one base, most pairs of them around the limit, and a base that many differ too much from."""
    rng = np.random.default_rng(15)
    base = [f"b{x}" for x in range(60)]
    texts = {}
    for k in range(160):
        words = list(base)
        for _ in range(int(rng.integers(1, 4))):
            words[int(rng.integers(60))] = f"e{int(rng.integers(10**6))}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = linked(jaccard_sets(texts))
    for rounds, hot in ((2, ngram_join.HOT), (0, ngram_join.HOT), (9, 20)):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, hot=hot).collect()} == want


def test_ngram_join_repeated_ids(spark):
    """Rows of one id are one document: linked by the set of each."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (9, b), (11, c), (12, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.ngram_components(docs).collect()))
    assert got == [(3, 8, 3), (5, 8, 3), (5, 8, 3), (9, 8, 3), (9, 8, 3), (11, 8, 11), (12, 0, 12)]


def test_ngram_heavy_signatures():
    """Members that a slice names at once, and those of the group, meet in one bucket; only one row of each slice is in the group."""
    rng, groups = np.random.default_rng(16), 3
    sig = np.uint64(0x123456789ABCDEF0)
    batches, nodes = [], []
    for _ in range(4):
        own = rng.integers(1, 2**62, ngram_join.HEAVY + 10)
        rows, sigs = np.arange(len(own)), np.full(len(own), sig)
        more = rng.integers(0, 2**63, 50).astype(np.uint64)
        batches.append(ngram_join._rows(own, np.full(len(own), 100, np.uint32), np.r_[rows, rng.integers(0, len(own), 50)], np.r_[sigs, more], groups))
        nodes += own.tolist()
    late = rng.integers(1, 2**62, 3)
    batches.append(ngram_join._rows(late, np.full(3, 101, np.uint32), np.arange(3), np.full(3, sig), groups))
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["kind"], r["g"]))
    held = [r for r in rows if r["kind"] == 1]
    low = [x for r in held for x in np.frombuffer(r["sigs"], np.uint32)]
    assert sum(x == np.uint32(0x9ABCDEF0) for x in low) == 4 + 3
    table = ngram_join.pa.RecordBatch.from_pylist(rows, schema=batches[0].schema)
    found = [r for b in ngram_join._search(80)(iter([table])) for r in b.to_pylist()]
    wide = {}
    for r in found:
        if r["bucket"]:
            wide.setdefault(r["bucket"], set()).add(r["node"])
    assert set(nodes) | set(late.tolist()) in wide.values()
    linked_to = {(r["centre"], r["node"]) for r in found if not r["bucket"]}
    assert len({n for _, n in linked_to}) >= len(set(nodes)) + 3 - 1


def test_cut_tables_are_cleared(spark):
    from pathlib import Path

    from clipweave.llm.shared import _own_folder, clear_tables, cut

    got = cut(spark.range(3).toDF("x"), "some-table")
    assert got.count() == 3 and list(Path(_own_folder(spark)).glob("some-table-*"))
    assert clear_tables(spark) and not Path(_own_folder(spark)).exists()


def test_by_key():
    from clipweave.llm.shared import by_key

    a = np.sort(np.random.default_rng(4).integers(0, 30, 500))
    table = ngram_join.pa.table({"a": a, "x": np.arange(500)})
    parts = list(by_key(iter(table.to_batches(max_chunksize=37)), ("a",)))
    assert [p.column("a")[0].as_py() for p in parts] == sorted(set(a.tolist()))
    assert np.concatenate([np.asarray(p.column("x")) for p in parts]).tolist() == list(range(500))


def test_partenum_shares_a_signature():
    rng = np.random.default_rng(7)
    for n in (4, 5, 7, 12, 40, 90, 300, 1500):
        for _ in range(8):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = int(rng.integers(0, n // 5 + 1))
            add = max(0, (5 * (n - drop)) // 4 - n)
            b = np.r_[a[drop:], rng.integers(0, 2**63, int(rng.integers(0, add + 1))).astype(np.uint64)]
            if 100 * (n - drop) < 80 * (len(b) + drop):
                continue
            row, sig = ngram_join.signatures([np.sort(a), np.sort(b)], 80)
            assert drop == 0 and len(a) == len(b) or n < 4 or set(sig[row == 0]) & set(sig[row == 1])


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 340)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    up = {n: n for e in edges for n in e}
    for _ in up:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
        if not changed:
            break
    assert got == {n: c for n, c in up.items() if any(a != b and n in (a, b) for a, b in edges)}


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n Shared line \n\nrare", f"s{i % 4}") for i in range(12)] + [(90, "Shared line\nShared line", None), (91, None, "s1"), (92, "", "s1"), (93, "rare2", "s0"), (93, "rare2", "s0"), (None, "Shared line\nx", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs, min_sites=5).where("doc_id <> 91 or doc_id is null").collect())
    by = {r[0][1]: r[1:] for r in got}
    assert by[3] == ("own 3\n\nrare", 4, 1) and by[90] == ("", 2, 2) and by[92] == ("", 1, 0) and by[None] == ("x", 2, 1) and sum(r[0][1] == 93 for r in got) == 2
    assert line_dedup.line_dedup(docs, min_sites=6).agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.line_dedup(docs, min_sites=5).where("doc_id = 91").first()["text"] is None
    assert line_dedup.line_dedup(docs.where("false")).count() == 0


def stats_by_hand(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    over = [any(tri.count(tri[j]) > 1 for j in range(max(0, k - 2), min(k, len(tri) - 1) + 1)) for k in range(len(w))]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>") if t else 0, len(lines) - len(set(lines)), sum(over))


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(["same line", *(f"own {k}" for k in range(60_000)), "y" * 1_000_000, "same line"])
    rows = [(0, long, "s0"), *((k, f"same line\nmine {k}", f"s{k}") for k in range(1, 9)), (1, "same line\nmine 1", "s1")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[0]["n_lines"] == 60_003 and by[0]["n_removed"] == 2 and by[0]["text"] == "\n".join(long.split("\n")[1:-1]) and by[1]["text"] == "mine 1"


def test_quality_stats(docs, texts):
    for d, t in texts.items():
        if d not in (47, 48):
            assert quality_rules.text_stats((t or "").encode())[:5] == stats_by_hand(t)
    assert quality_rules.text_stats("a b c a b c\nx\nx\n \n \n#<".encode())[:5] == stats_by_hand("a b c a b c\nx\nx\n \n \n#<")
    got = {r["doc_id"]: r["base_failed"] for r in quality_rules.document_stats(docs).collect()}
    assert got == {d: (s := stats_by_hand(t) if d not in (47, 48) else (4000, 0, 0, 0, 4000))[0] < 50 or 100 * s[4] > 50 * s[0] for d, t in texts.items()}


def test_quality_rules_learn(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = {f: rng.random(n) for f in quality_rules.FEATURES}
    bad = (x["symbol_share"] > 0.7) | ((x["mean_word"] > 0.8) & (x["upper_share"] < 0.5))
    rules = quality_rules.learn(x, bad)
    fresh = {f: rng.random(4000) for f in x}
    truth = (fresh["symbol_share"] > 0.7) | ((fresh["mean_word"] > 0.8) & (fresh["upper_share"] < 0.5))
    said = np.zeros(4000, bool)
    for r in rules:
        said |= quality_rules._holds(fresh, r.conditions)
    assert (said == truth).mean() > 0.95 and truth[said].mean() > 0.95
    assert quality_rules.learn(x, np.zeros(n, bool)) == [] and quality_rules.learn({f: np.zeros(0) for f in x}, np.zeros(0, bool)) == []


def test_quality_rules_end_to_end(spark, docs, empty):
    good = "The quick brown fox jumps over lazy dogs while rain falls on quiet hills and rivers run past old stone mills near small towns "
    rows = [(i, f"{good}{i} " + " ".join(f"v{i}q{k}" for k in range(60))) for i in range(60)] + [(100 + i, " ".join(f"w{i}r{k}###" for k in range(70))) for i in range(40)] + [(200, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)] + [(5, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(d, labels).where("kept").collect()}
    assert kept == set(range(60))
    assert {r["doc_id"] for r in quality_rules.keep_good(d, labels).collect()} == kept and quality_rules.keep_good(d, labels).columns == d.columns
    assert quality_rules.quality_rules(empty, labels).count() == 0 and quality_rules.quality_rules(docs, labels.where("false")).count() == docs.count()


def test_quality_query_by_hand(spark, duck):
    """The registered query against SQL for the base columns, and its verdicts against the learned rules applied by hand."""
    sf = SF.replace("sf0.001", "sf0.01")  # the smallest table of which rules are learned
    got = {r["doc_id"]: r for r in catalog.op9_quality_rules(spark, sf).collect()}
    base = duck.execute(rf"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from '{sf}/documents.parquet'
        ), tri as (select doc_id, i, w[i:i + 2] as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
        ), twice as (select doc_id, t from tri group by all having count(*) > 1
        ), rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from tri join twice using (doc_id, t)) group by doc_id)
        select d.doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), coalesce(list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')))), 0),
               len(ls) - len(list_distinct(ls)), coalesce(n, 0) from d left join rep using (doc_id)""").fetchall()
    assert {d: tuple(map(int, r)) for d, *r in base} == {d: tuple(r[c] for c in quality_rules.STATS) for d, r in got.items()}
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    assert rules
    for r in docs.collect():
        x = dict(zip(quality_rules._NAMES, quality_rules.text_stats((r["text"] or "").encode()), strict=True))
        first = None
        if not (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]):
            value = {f: eval(e.replace("greatest", "max").replace("cast(n_words as double)", "n_words"), {}, x | {"max": max}) for f, e in quality_rules.FEATURES.items()}  # noqa: S307
            first = next((k for k, rule in enumerate(rules, 1) if all(value[f] >= t if up else value[f] <= t for f, up, t in rule.conditions)), None)
        g = got[r["doc_id"]]
        assert (g["base_failed"], g["rule"], g["kept"]) == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"], first, not g["base_failed"] and first is None)


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(3000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 6000, 2)] + [(4, 0), (6, None), (None, 1)], "doc_id long, quality int")
    for sample in (100, 700, 5000):
        rows = quality_rules._sampled(docs, labels, sample).collect()
        assert len(rows) == len({r["doc_id"] for r in rows}) and len(rows) <= sample
        assert len(rows) == 1500 if sample == 5000 else len(rows) > 0.8 * sample


def test_quality_sample_of_few_more_labels(spark):
    """A few more labels than the sample: the threshold is then the largest long, and all of them are looked at."""
    docs = spark.createDataFrame([(i, "x") for i in range(1500)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    rows = quality_rules._sampled(docs, labels, 1450).collect()
    assert len({r["doc_id"] for r in rows}) == 1450


def share_by_hand(budget, cap, weight):
    """Water-filling in small steps over exact fractions."""
    from fractions import Fraction

    got, left, open_ = {k: Fraction(0) for k in cap}, Fraction(budget), {k for k in cap if weight[k]}
    while open_ and left > 0:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if cap[k] <= level * weight[k]}
        for k in full or open_:
            got[k] = Fraction(cap[k]) if full else level * weight[k]
        left, open_ = left - sum(got[k] for k in (full or open_)), open_ - full if full else set()
    return {k: int(x) for k, x in got.items()}


def test_mixing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), "en" if rng.random() < 0.6 else None if rng.random() < 0.2 else "de", f"src{int(rng.integers(0, 9))}") for i in range(400)]
    rows += [(900, None, "en", "src1"), (901, "  ", "en", "src1"), (902, "w w w", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash"))
    opt = {"fraction": 0.8, "max_epochs": 2, "domains": {"d0": 5, "d1": 1}, "langs": {"en": 3}, "seed": 5}
    leaves, of = {}, {}
    for i, t, la, so in rows:
        n = len((t or "").split())
        if n:
            k = (f"d{int(so[3:]) % 4 if so else 0}", la or "", so or "")
            of[i] = (k, n)
            leaves[k] = leaves.get(k, 0) + n
    total = int(sum(leaves.values()) * 0.8)
    cap = {k: 2 * v for k, v in leaves.items()}
    group = lambda m: {x: sum(v for k, v in cap.items() if k[:m] == x) for x in {k[:m] for k in cap}}
    b1 = share_by_hand(total, group(1), {k: opt["domains"].get(k[0], 1) for k in group(1)})
    budget = {}
    for d, b in b1.items():
        g2 = {k: v for k, v in group(2).items() if k[:1] == d}
        for k2, b2 in share_by_hand(b, g2, {k: opt["langs"].get(k[1], 1) for k in g2}).items():
            g3 = {k: v for k, v in cap.items() if k[:2] == k2}
            budget |= share_by_hand(b2, g3, dict.fromkeys(g3, 1))
    want = {}
    for k, b in budget.items():
        e, rest = divmod(b, leaves[k])
        run = 0
        for key, i in sorted((hashlib.md5(f"5:{e}:{i}".encode()).hexdigest(), i) for i, (x, _) in of.items() if x == k):
            run += of[i][1]
            if e + (run <= rest):
                want[i] = e + (run <= rest)
    got = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs, **opt).collect()}
    assert got == want
    full = mixing.mix_sources(docs, **opt)
    assert full.columns == docs.columns and {r["doc_id"]: r["count"] for r in full.groupBy("doc_id").count().collect()} == want
    assert mixing.mix_sources(docs.where("false"), **opt).count() == 0


def test_mixing_repeated_rows_and_long_texts(spark):
    rows = [(1, "w " * 300_000, "en", "s1"), (2, "a b c", "en", "s1"), (2, "a b c", "en", "s1"), (3, "x", "de", "s2"), (None, "n n", "en", "s1"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit("clash"))
    opt = {"fraction": 1.0, "max_epochs": 1}
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["copies"]) for r in mixing.mix_plan(docs, **opt).collect())
    assert got == [(0, 2, 1), (1, 300_000, 1), (2, 3, 1), (2, 3, 1), (3, 1, 1)]
    assert mixing.mix_sources(docs, **opt).count() == 5


def brute_pieces(model, text):
    t, out = (" " + text).replace(" ", pieces.SPACE), []

    def walk(at, ids, score):
        if at == len(t):
            out.append((score, tuple(ids)))
            return
        for end in range(at + 1, min(len(t), at + model.longest) + 1):
            if (i := model.ids.get(t[at:end])) is not None:
                walk(end, [*ids, i], score + model.score[i])
        if t[at] not in model.ids:
            walk(at + 1, [*ids, *(model.byte[x] for x in t[at].encode())], score + model.floor)

    walk(0, [], 0.0)
    return sorted(out, key=lambda r: -r[0])


@pytest.mark.parametrize("text", ["hello", "a  b", "the cat", "ab\ncd", "ಠx", "foo bar\n baz", " x ", "\n\n", "x" * 9])
def test_pieces_nbest(text):
    model = pieces.lattice(PIECES)
    every = brute_pieces(model, text)
    by = {ids: s for s, ids in every}
    for n in (1, 2, 4, 9):
        ids, scores = model.nbest(text, n)
        assert scores == [s for s, _ in every[:n]] and len({tuple(x.tolist()) for x in ids}) == len(ids)
        assert all(by[tuple(x.tolist())] == s for x, s in zip(ids, scores)) and model.decode(ids[0]) == text


def k_best(model, unit, k):
    """Scores of the k best segmentations by dynamic programming forward, another way than the search."""
    best = [[0.0]]
    for b in range(1, len(unit) + 1):
        here = []
        for a in range(max(0, b - model.longest), b):
            if unit[a:b] in model.ids:
                here += [x + model.score[model.ids[unit[a:b]]] for x in best[a]]
            elif b - a == 1:
                here += [x + model.floor for x in best[a]]
        best.append(sorted(here, reverse=True)[:k])
    return best[-1]


def test_pieces_of_long_units():
    model, rng = pieces.lattice(PIECES), np.random.default_rng(21)
    for n, letters in ((49, "abcdeé"), (60, "0123456789abcdef"), (130, "thean日本"), (400, "ab")):
        unit = "".join(rng.choice(list(letters), n))
        got = model.search(unit, 5)
        assert [s for s, _ in got] == k_best(model, unit, 5) and len({ids for _, ids in got}) == 5
        for s, ids in got:
            assert model.decode_bytes(np.array(ids)) == unit.encode()[1:]  # less the place of the space in front
    # Short units go through arrays: the same answer as the search, ties included.
    for unit in {"".join(rng.choice(list("then"), int(rng.integers(1, 40)))) for _ in range(60)}:
        model._forget()
        model._learn([unit])
        both = model.search(unit, 2)
        assert tuple(model.flat.tolist()) == both[0][1] and model.scores[0] == both[0][0]
        assert model.losses[0] == (both[0][0] - both[1][0] if len(both) > 1 else np.inf)
    model._forget()


def test_pieces_memory_grows_with_the_unit():
    import tracemalloc

    model, rng = pieces.lattice(PIECES), np.random.default_rng(22)
    text = "".join(rng.choice(list("0123456789abcdef"), 100_000))
    tracemalloc.start()
    best, scores = model.nbest(text, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    model._forget()
    assert peak < 64 << 20 and len(best) == 4 and scores == sorted(scores, reverse=True) and all(model.decode(x) == text for x in best)


def test_pieces_against_the_library():
    """Ids are those of the likeliest pieces, not of the merges: most words are cut alike, and texts have about as many pieces."""
    import sentencepiece

    model, sp = pieces.lattice(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = "the cat and other small animals were sleeping near an old river while children played football with their parents under tall trees".split()
    assert sum(model.nbest(w, 1)[0][0].tolist() == sp.encode(w) for w in words) >= 0.6 * len(words)
    assert len(model.nbest(" ".join(words), 1)[0][0]) <= 1.1 * len(sp.encode(" ".join(words)))


def test_pieces_table(spark, docs, texts, empty):
    got = pieces.encode(docs, PIECES, nbest=3)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows.values()) and rows[40]["ids"] == [] and rows[41]["scores"] == [0.0]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"][0] for r in rows.values())
    assert {r["doc_id"]: r["text"] for r in pieces.decode(got, PIECES).collect()} == {d: t or "" for d, t in texts.items()}
    assert pieces.encode(empty, PIECES).count() == 0


def test_rans_round_trip(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    want = {d: [*model.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    path = rans.write_tokens(docs, BPE, str(tmp_path / "out"), block_tokens=500, lanes=16)
    got = {r["doc_id"]: r for r in rans.read_tokens(spark, path).collect()}
    start = 0
    for d in sorted(want):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids"]) == (start, len(want[d]), want[d])
        start += len(want[d])
    assert rans.token_output(empty, BPE).count() == 0


def test_rans_marks_compose_before_lower_case():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    texts = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "One J\u030c TWO", "ONE Two", "H\u0331 <|X", "\u00c9A E\u0301a"]
    want = [[*model.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    words = rans.words(BPE)
    for batch in ([[t] for t in texts], [texts]):  # alone and with a filled cache
        got = [np.frombuffer(x, words.dtype).tolist() for part in batch for x in words.encode([t.encode() for t in part], 1)]
        assert got == want


def test_rans_digest_is_the_tokenizers(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    odd = ["don't I'LL x's ''s ''ll't", "\u00c0\u00c9\u00ce\u00ff\u00df \u00f7\u00d7\u00b5\u00aa\u00ba", "\u03a3\u0391\u03a3 \u0130I \ufb01", "<|endoftext|>a x<|endoftext|>Y <|EndOfText|>", "a\u00a0b\u3000c \uff11\u00bd", "\x1c\x1da\x85b", "123abc4.5,,;\u00e91\u00e9", "na\u00efve! \u00c9!\u00c9? \u0152", "z" * 20_000, "q1 " * 9_000]
    rows = dict(enumerate([*texts.values(), *odd]))
    want, start = {}, 0
    for d, t in rows.items():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = rans.token_output(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5), BPE)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()} == want


def test_rans_shard_starts(spark):
    sizes = {s: 1 + s * s % 7 for s in range(2500)}
    got = {r["shard"]: r["shard_start"] for r in rans._starts(spark.createDataFrame([(s, n) for s, n in sizes.items()] * 2, "shard int, n_tokens long")).collect()}
    assert got == {s: 2 * sum(sizes[k] for k in range(s)) for s in sizes}


def test_rans_blocks():
    rng = np.random.default_rng(8)
    tokens = rng.zipf(1.3, 60_000) % 400
    freq = rans.frequencies({int(s): int(n) for s, n in zip(*np.unique(tokens, return_counts=True))}, 500)
    coder = rans.Coder(freq)
    block = coder.encode(tokens, lanes=32, every=100)
    assert (coder.decode(block) == tokens).all() and (coder.decode(block, 3, 5) == tokens[3 * 3200 : 5 * 3200]).all()
    for n in (0, 1, 31, 32, 33):
        assert (coder.decode(coder.encode(tokens[:n], lanes=32)) == tokens[:n]).all()
    with pytest.raises(ValueError):
        coder.decode(block[:99] + bytes([block[99] ^ 1]) + block[100:])
    for counts in ({7: 5}, {0: 1, 1: 10**12}, dict.fromkeys(range(500), 1)):
        assert rans.frequencies(counts, 500).sum() == 1 << rans.SCALE


def test_topk_prunes_clusters():
    """Exact on vectors with and without structure; with it, the bounds leave out most pairs before their exact products."""
    rng = np.random.default_rng(19)
    near = np.repeat(rng.normal(size=(40, 64)), 150, axis=0) + 0.05 * rng.normal(size=(6000, 64))
    for x, most in ((rng.normal(size=(3000, 64)), 1.0), (near, 0.5), (rng.integers(0, 2, (2000, 7)).astype(float), 1.0)):
        c = np.floor(64 * x)
        ids = rng.permutation(len(c))
        asks, seen = ids % 50 == 0, np.zeros(5)
        got = set(zip(*(map(int, r) for r in topk.best(ids, c, ids[asks], c[asks], 5, None, seen)), strict=True))
        want = set()
        for i, q in zip(ids[asks], c[asks], strict=True):
            s = sorted((-int(v), int(j)) for v, j in zip(c @ q, ids, strict=True) if j != i)[:5]
            want |= {(int(i), j, -v) for v, j in s}
        assert got == want and seen[-1] <= most * asks.sum() * len(ids)


def test_topk_with_thresholds_of_a_sample(spark, monkeypatch):
    rng = np.random.default_rng(20)
    df = spark.createDataFrame([(i, [float(np.float32(v)) for v in rng.normal(size=16)]) for i in range(900)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, topk.exact_topk(df).collect()))
    monkeypatch.setattr(topk, "SAMPLE", 100)
    assert sorted(map(tuple, topk.exact_topk(df).collect())) == want and len(want) == 90


def test_topk(spark):
    rng = np.random.default_rng(9)
    v = {i: [float(np.float32(x)) for x in rng.normal(size=12)] for i in range(230)}
    v |= {230: v[50], 231: v[50], 240: [float("nan")] * 12, 250: None, 260: [], 270: [1.0, 2.0], 300: [1.0, 3.0], 310: [None] + [1.0] * 11, 320: [float("inf")] + [0.0] * 11, 350: [1e9] * 12, 351: [-1e9] * 12}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    q = {i: np.floor(256 * np.array(x, np.float32).astype(float)) for i, x in v.items() if x and all(c is not None and np.isfinite(c) for c in x)}
    want = set()
    for i in (i for i in q if i % 50 == 0):
        s = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], x)), j) for j, x in q.items() if j != i and len(x) == len(q[i]))[:5]
        want |= {(i, k, j, max(-(1 << 63), min((1 << 63) - 1, -m))) for k, (m, j) in enumerate(s, 1)}
    assert {tuple(r) for r in topk.exact_topk(df).collect()} == want
    assert topk.exact_topk(df.where("false")).count() == 0


def test_quotation(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "bot", "> how ARE  you?\nFine."), (1, 2, "user", "Bob wrote:\n>> How are you?\n> Fine.\n\nGood."),
        (1, 3, "bot", "> never said\nhm"), (1, 4, "user", "> Good.\nok"), (1, 5, "user", "> ok\nself\n> later"), (1, 6, "bot", "later"),
        (2, 0, "user", None), (2, 1, "bot", ""), (None, 0, "user", "> x"), (2, None, "user", "y"), (2, 1, "bot", ""), (3, 0, None, "a > b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = quotation.reply_order(df)
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert got.count() == len(rows)
    assert [(by[1, k]["text"], by[1, k]["parent_turn"], by[1, k]["root_turn"], by[1, k]["depth"]) for k in range(7)] == [
        ("Hello there.\nHow are you?", None, 0, 0), ("Fine.", 0, 0, 1), ("Good.", 1, 0, 2), ("hm", None, 3, 0), ("ok", 2, 0, 3), ("self", 4, 0, 4), ("later", None, 6, 0)]
    assert (by[1, 2]["n_quotes"], by[1, 2]["n_linked"], by[1, 2]["max_level"]) == (2, 2, 2) and by[3, 0]["text"] == "a > b" and by[2, 0]["text"] == "" and by[None, 0]["n_linked"] == 0
    order = quotation.render(got).where("conv_id = 1").orderBy("root_turn", "place").collect()
    assert [r["turn"] for r in order] == [0, 1, 2, 4, 5, 3, 6] and [r["place"] for r in order] == [0, 1, 2, 3, 4, 0, 0]
    assert quotation.reply_order(df.where("false")).count() == 0 and quotation.quote_links(df).count() == 7


def planted_conversations(rng, n=60):
    """(rows, turn each reply truly answers): replies quote runs of lines of an earlier message, some re-wrapped, some with a line of their own inside."""
    rows, truth = [], {}
    for conv in range(n):
        said = []
        for turn in range(int(rng.integers(3, 14))):
            own = [" ".join(f"w{int(x)}" for x in rng.integers(0, 500, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(1, 26)))]
            text = list(own)
            if said and rng.random() < 0.8:
                k = int(rng.integers(0, len(said)))
                a = int(rng.integers(0, len(said[k])))
                quoted = said[k][a : a + int(rng.integers(1, 24))]
                if rng.random() < 0.2 and len(quoted) > 2:
                    quoted = [*quoted[:2], f"on day {turn} someone said", *quoted[2:]]
                elif rng.random() < 0.2 and a == 0 and len(quoted) == len(said[k]):
                    quoted = [" ".join(quoted).upper()]
                text = [*(f"{rng.choice(['> ', '>', ' >  '])}{q}" for q in quoted), "", *own]
                truth[conv, turn] = k
            said.append(own)
            rows.append((conv, turn, "user" if turn % 2 else "bot", "\n".join(text)))
    return rows, truth


def test_quotation_recall_and_sql(spark, duck):
    rows, truth = planted_conversations(np.random.default_rng(31))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotation.reply_order(df).collect()}
    hits = sum(got[k]["parent_turn"] == v for k, v in truth.items())
    assert hits >= 0.95 * len(truth) and all(r["parent_turn"] is None for k, r in got.items() if k not in truth)
    for (conv, turn), r in got.items():  # a reply stands after its parent, before whatever is no descendant of it
        if r["parent_turn"] is not None:
            above = got[conv, r["parent_turn"]]
            assert r["place"] > above["place"] and r["depth"] == above["depth"] + 1 and r["root_turn"] == above["root_turn"]
            later = [x for (c, _), x in got.items() if c == conv and x["root_turn"] == r["root_turn"] and above["place"] < x["place"] < r["place"]]
            assert all(x["depth"] > above["depth"] for x in later)
    own = duck.cursor()
    own.register("planted", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = own.execute(catalog.SQL["op1_quotation_linking"].replace("from conversations", "from planted")).df()
    out = quotation.threads(quotation.render(quotation.reply_order(df)))
    assert plain(out.withColumn("chat", F.sha2("chat", 256)).withColumnRenamed("chat", "chat_sha256").toPandas()) == plain(want)


def test_quotation_excerpts(spark):
    text = "first line\nsecond line\nthird line\n\nlast paragraph"
    replies = ["> first line\n> second line\nyes", "> third line\n>\n> last paragraph\nyes", "> second line\n> third line\n> -- \n> my signature\nyes", "> none of it\n> at all\nno"]
    df = spark.createDataFrame([(1, 0, "a", text), *((1, k, "b", t) for k, t in enumerate(replies, 1))], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["parent_turn"] for r in quotation.reply_order(df).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: None}
    long = "\n".join(f"line {k}" for k in range(3000))
    df = spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", "\n".join(f"> line {k}" for k in range(500, 2500)))] + [(2, k, "c", f"> m{k - 1}\nm{k}") for k in range(150)], "conv_id long, turn long, role string, text string")
    out = quotation.reply_order(df)
    assert out.where("conv_id = 1 and turn = 1").first()["parent_turn"] == 0
    parts = quotation.threads(quotation.render(out)).where("conv_id = 2").orderBy("part").collect()
    assert [r["n_messages"] for r in parts] == [64, 64, 22] and ",".join(r["turns"] for r in parts) == ",".join(map(str, range(150)))
    assert quotation.threads(quotation.render(quotation.reply_order(df.where("false")))).count() == 0


def test_quotation_of_long_passages(spark, duck):
    """Passages of 17 to 200 lines belong to the first message that has all of their lines in a row; a head or an end that others have too decides nothing."""
    line = lambda a, b: [f"line {k}" for k in range(a, b)]
    quote = lambda lines: "\n".join(f"> {x}" for x in lines) + "\nyes"
    changed = line(1, 61)
    changed[30] = "never said"
    rows = [(1, 1, line(1, 17)), (1, 2, line(1, 21)), (1, 4, [*line(1, 17), "odd", *line(5, 21)]), (2, 1, changed), (2, 2, line(1, 61)), (3, 1, changed)]
    rows = [(c, t, "\n".join(x)) for c, t, x in rows] + [(1, 3, quote(line(1, 21))), (2, 3, quote(line(1, 61))), (3, 2, quote([*line(1, 25), "else", *line(40, 50)]))]
    rng, truth = np.random.default_rng(17), {(1, 3): 2, (2, 3): 2, (3, 2): None}
    for conv in range(10, 40):
        said = {}
        for turn in range(6):
            said[turn] = [f"c{conv} t{turn if rng.random() < 0.3 else 0} l{k}" for k in range(int(rng.integers(150, 260)))]
            if turn % 2:
                at, n, of = int(rng.integers(0, 40)), int(rng.integers(17, 110)), 2 * int(rng.integers(0, (turn + 1) // 2))
                part = said[of][at : at + n]
                rows.append((conv, turn, quote(part)))
                said[turn] = ["yes"]
                truth[conv, turn] = next(t for t in range(turn) if any(said[t][k : k + n] == part for k in range(len(said[t]))))
            else:
                rows.append((conv, turn, "\n".join(said[turn])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("a"))
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotation.reply_order(df).collect()}
    # The changed passage has most of its lines from the message, so that it belongs to it by its lines, not as a whole.
    assert got.pop((3, 2)) == 1 and {k: got[k] for k in truth if k != (3, 2)} == {k: v for k, v in truth.items() if k != (3, 2)}
    own = duck.cursor()
    own.register("planted", df.toPandas())
    want = own.execute(catalog.SQL["op1_quotation_linking"].replace("from conversations", "from planted")).df()
    out = quotation.threads(quotation.render(quotation.reply_order(df)))
    assert plain(out.withColumn("chat", F.sha2("chat", 256)).withColumnRenamed("chat", "chat_sha256").toPandas()) == plain(want)
