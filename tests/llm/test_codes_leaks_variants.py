"""Vector codes, benchmark decontamination and spelling variants against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipweave.llm import codes, leaks, ngram_join, variants

LEAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vector codes


@pytest.mark.parametrize("m", [1, 2, 4, 8, 16, 32])
def test_sequency_order(m):
    h = codes.hadamard(np.eye(m, dtype=np.int64))
    assert [int((np.diff(h[:, k]) != 0).sum()) for k in range(m)] == list(range(m))
    assert (h.T @ h == m * np.eye(m)).all()


@pytest.mark.parametrize("width,top", [(8, 1 << 12), (5, 7), (1, 3), (3, 1 << 40), (8, 1 << 61)])
def test_nearest_is_exact(width, top):
    """Every distance by Python's own integers; small ranges make ties."""
    rng = np.random.default_rng(width)
    x, c = rng.integers(-top, top, (200, width)), rng.integers(-top, top, (16, width))
    x[:4] = c[3]
    index, error = codes.nearest(x, c)
    for row, i, e in zip(x.tolist(), index, error, strict=True):
        d = [sum((a - b) ** 2 for a, b in zip(row, entry, strict=True)) for entry in c.tolist()]
        assert (int(i), int(e)) == (d.index(min(d)), min(d))


def test_entries_go_early():
    """Smooth vectors differ in their first coefficients: most others are never looked at."""
    rng = np.random.default_rng(5)
    c = np.sort(rng.integers(-4000, 4000, (16, 1)), axis=0) + rng.integers(-50, 50, (16, 16))
    x = c[rng.integers(0, 16, 3000)] + rng.integers(-50, 50, (3000, 16))
    looked: list[int] = []
    codes.nearest(x, c, looked)
    assert looked[0] < looked[1] / 3


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [[max(-(1 << 62), min(1 << 62, int(np.floor(np.float64(x) * 4096)))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[r][p] for r in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            d = [[sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)) for e in books[p]] for p in range(parts)]
            out.append([(x.index(min(x)), min(x)) for x in d])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut[r][p] for r in range(len(cut)) if found[r][p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found, total = assign(), defaultdict(int)
    error = [sum(d for _, d in f) for f in found]
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] += e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    low = lambda x: min(x, (1 << 63) - 1)
    return sorted((str(i), "".join(f"{k:02x}" for k, _ in f), low(e), low(total[label])) for (i, _, label), f, e in zip(kept, found, error, strict=True)), sha


@pytest.mark.parametrize("case", ["plain", "odd", "huge", "few"])
def test_codes_against_brute_force(spark, case):
    rng = np.random.default_rng(7)
    dims, n = {"plain": (64, 120), "odd": (19, 60), "huge": (8, 40), "few": (16, 5)}[case]
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, dims)], int(rng.integers(3))) for i in range(n)]
    if case == "odd":
        rows += [(3, rows[3][1], None), (3, rows[3][1], None), (None, rows[5][1], 1), (70, [], 2), (71, None, 2), (72, [1.0, None], 2), (73, [float("nan")] * 19, 1), (74, [float("-inf")] * 19, 1), (75, [0.5] * 7, None)]
    if case == "huge":
        rows += [(100 + k, [float(x) for x in rng.normal(0, 10.0 ** (4 * k), dims)], 0) for k in range(8)] + [(200, [1e300] * dims, 1)]
    frame = spark.createDataFrame([(i, v, c, "x") for i, v, c in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got, books = codes.compress(frame)
    want, sha = plain_codes(rows)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got.collect()) == want and books.sha256() == sha


def test_codes_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    got, books = codes.compress(empty)
    assert got.count() == 0 and books.text() == ""
    rows = [(k, [float(x) for x in np.random.default_rng(k).normal(0, 1, 24)], k % 2) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, books = codes.compress(frame, entries=60, rounds=1)
    for r in codes.decode(out, books, 24).collect():
        assert np.abs(np.array(r["approx"]) - np.array(rows[r["vec_id"]][1])).max() < 1.01 / 4096  # an entry each
    few = codes.with_label_error(out.drop("label_error"), heavy=1)  # no label is common
    assert sorted(map(tuple, few.select("vec_id", "label_error").collect())) == sorted(map(tuple, out.select("vec_id", "label_error").collect()))


# --- benchmark decontamination


def plain_leaks(texts, items, width=10):
    words = lambda t: LEAK.findall((t or "").translate(LOWER))
    strings = defaultdict(set)
    for name, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            strings[tuple(w[k : k + width])].add(name)
    out = []
    for d, t in texts:
        w, hit, met = words(t), set(), set()
        for size in {len(s) for s in strings}:
            for k in range(len(w) - size + 1):
                if (s := tuple(w[k : k + size])) in strings:
                    hit |= set(range(k, k + size))
                    met |= strings[s]
        out.append((str(d), len(w), tuple(sorted(hit)), tuple(sorted(str(m) for m in met if m is not None))))
    return sorted(out)


@pytest.fixture(scope="module")
def leaky():
    rng = np.random.default_rng(2)
    vocab = np.array(["a", "B", "cd", "Éa", "x1", "日本", "internationalisation1", "internationalisation2", "zz", "q"])
    say = lambda n, v=vocab: "".join(w + str(rng.choice([" ", "-", "\n", "_ ", ". "])) for w in rng.choice(v, n))
    items = [(k, say(int(rng.integers(10, 30)))) for k in range(30)] + [(40, "a B"), (41, "zz zz zz q"), (42, None), (43, ""), (44, "... !"), (45, "cd " * 400), (3, say(12)), (None, say(11)), (46, "unique")]
    texts = []
    for k in range(80):
        t = say(int(rng.integers(0, 60)), vocab[:4] if k % 3 else vocab)
        if k % 2:
            t += " " + (items[int(rng.integers(len(items)))][1] or "").upper() + " " + say(5)
        texts.append((k, t))
    long = say(3000) + items[7][1] + say(3000) + items[9][1]
    return texts + [(90, None), (91, ""), (92, " \n"), (93, long), (93, long), (None, items[1][1]), (94, "cd " * 9), (95, "cd " * 10), (96, "UNIQUE"), (97, "uniquex")], items


def spans_of(r):
    assert all(a["end"] < b["start"] for a, b in itertools.pairwise(r["spans"]))
    return tuple(w for s in r["spans"] for w in range(s["start"], s["end"]))


@pytest.mark.parametrize("width,group", [(10, 4 << 20), (10, 3000), (3, 4 << 20), (1, 4 << 20)])
def test_leaks_against_brute_force(spark, leaky, width, group):
    texts, items = leaky
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, piece string")
    got = leaks.find_leaks(docs, bench, width=width, group_bytes=group).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], spans_of(r), tuple(r["items"])) for r in got) == plain_leaks(texts, items, width)


def test_leaks_edges(spark, leaky):
    texts, items = leaky
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.find_leaks(docs.where("false"), bench).count() == 0
    assert leaks.find_leaks(docs, bench.where("false")).where("size(spans) > 0 or size(items) > 0").count() == 0


@pytest.mark.parametrize("limit", [40, 4000])
def test_pieces_of_long_texts(leaky, limit):
    """A text searched piece by piece has the words, covered words and items of the whole."""
    texts, items = leaky
    search = leaks.Search([(t or "").encode() for _, t in items], 10)
    for _, t in texts:
        if limit < 100 and len(t or "") > 2000:
            continue
        b = (t or "").encode()
        n, spans, hits = search.scan([b])[0]
        total, found, met = 0, [np.zeros((0, 2), np.int64)], set()
        for before, piece in leaks.pieces_of(b, 10, limit):
            k, s, h = search.scan([piece])[0]
            total, met = before + k, met | set(h.tolist())
            found.append(s + before)
        assert total == n and met == set(hits.tolist()) and leaks.joined(np.concatenate(found)).tolist() == leaks.joined(spans).tolist()


def test_shifts_skip_places(leaky):
    rng = np.random.default_rng(1)
    search = leaks.Search([" ".join(f"t{x}" for x in rng.integers(0, 500, 20)).encode() for _ in range(50)], 10)
    words = leaks.Words([" ".join(f"w{x}" for x in rng.integers(0, 5000, 40_000)).encode()])
    stops: list[int] = []
    assert not len(search.occurrences(words, search.tables[0], stops)[0]) and sum(stops) < 40_000 / 7


# --- spelling variants


def plain_variants(counts, ratio=10):
    words = sorted(counts)
    near = defaultdict(set)
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in less.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("hot", [4, 50, 8192])
def test_variants_against_brute_force(spark, hot):
    """Words of few letters, so that many are alike; a low ``hot`` deals groups again down to one place."""
    rng = np.random.default_rng(hot)
    base = ["".join(rng.choice(list("abcé÷"), int(rng.integers(6, 11)))) for _ in range(60)]
    counts = Counter()
    for w in base:
        counts[w] += int(rng.integers(1, 3000))
        for _ in range(12):
            i, kind = int(rng.integers(len(w))), int(rng.integers(3))
            x = str(rng.choice(list("abcé÷")))
            counts[w[:i] + x * (kind > 0) + w[i + (kind < 2) :]] += int(rng.integers(1, 40))
            w = w if rng.random() < 0.5 else w[:i] + x + w[i:]
    counts |= {"a": 5, "b": 90, "ab": 3, "xaaaaaaa": 2, "aaaaaaax": 30, "aaaaaaa": 500, "y" * 3000: 2, "y" * 2999: 40, "日本語": 3, "日本": 60}
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 4, "x"), ("", 3, "x"), ("zz", None, "x")]
    frame = spark.createDataFrame(rows, "word string, n long, form string").repartition(3)
    got = sorted(map(tuple, variants.group_variants(frame, hot=hot).collect()))
    assert got == plain_variants(counts)


def test_variants_of_one_block():
    """The bit sets alone, all pairs of a block against the definition."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("ab"), int(n))) for n in rng.integers(7, 9, 150)})
    i, j = variants.near(words, 7)
    got = {(words[a], words[b]) for a, b in zip(i, j, strict=True)}
    less = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    one = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else a in less(b) or b in less(a)
    assert len(got) == len(i) and got == {(a, b) for a in words for b in words if min(len(a), len(b)) == 7 and one(a, b)}


def test_vocabulary(spark):
    texts = [(1, "Variant variant VARIANT spelling, spelling-spellings"), (2, "variant été naïveté×÷ naïveté×÷ ab1variant"), (2, "variant"), (None, "spelling"), (3, None), (4, "")]
    texts += [(k, " ".join(f"wordnumber{chr(97 + k % 26)}" for _ in range(3))) for k in range(10, 200)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, word string")
    want = Counter()
    for d, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    assert dict(map(tuple, variants.vocabulary(docs).collect())) == {w: n for w, n in want.items() if n >= 2}
    assert variants.group_variants(variants.vocabulary(docs.where("false"))).count() == 0
    assert variants.vocabulary(docs, slip=None).where(F.col("word") == "variant").first()["n"] == 6


# --- n-gram join of long documents


def test_parities_of_different_widths():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 1100).astype(np.uint64))
    sets = [base[:1000], base[40:1040], base[:1060], base[:500], base[:0]]
    assert [len(ngram_join.parity(s)) for s in sets] == [32, 32, 64, 16, 16]
    rows = ngram_join.folded(pa.array([ngram_join.parity(s) for s in sets], pa.list_(pa.int64())))
    bits = lambda a, b: int(np.bitwise_count((rows[a] ^ rows[b]).view(np.uint64)).sum())
    for a, b in itertools.combinations(range(5), 2):
        apart = len(np.setxor1d(sets[a], sets[b]))
        assert bits(a, b) <= apart and (apart - bits(a, b)) % 2 == 0 and bits(a, b) > 0


def test_long_unlike_documents_are_seldom_compared(spark, monkeypatch):
    """Documents of 3,000 words of which 53 are their own are about 0.7 alike: their sets are fetched for few pairs, and none is linked; copies of 0.9 are."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(3000)]

    def changed(n):
        words = list(base)
        for at in rng.choice(3000, n, replace=False):
            words[at] = f"own{rng.integers(1 << 40)}"
        return words

    docs = {k: changed(106) for k in range(60)}
    for k in range(60, 64):
        words = list(docs[k - 60])
        for at in rng.choice(3000, 20, replace=False):
            words[at] = f"new{rng.integers(1 << 40)}"
        docs[k] = words
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    asked, plain = [], ngram_join._verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame).collect()}
    assert got == {k: k - 60 if k >= 60 else k for k in docs}
    assert sum(asked) < 0.05 * 64 * 63 / 2
