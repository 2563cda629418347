"""Quality rules: document statistics and a learned decision list.

The list is learned by sequential covering. Each rule is grown as a conjunction of thresholds on the
statistics, one condition at a time by information gain on two thirds of the labelled rows, then pruned
on the other third; rows that it covers are set aside and the next rule is sought. The ordered rules become
one Spark ``CASE WHEN`` expression, so that scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import long_doc, slices, utf8

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions may test, as SQL over the statistics. Sizes are left to the base rules, which are exact.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stop_share": "n_punct / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "n_words": "cast(n_words as double)",
}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.zeros((5, 256), bool)
for _row, _of in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?")):
    _CLASS[_row, list(_of)] = True
_NAMES = (*STATS, "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct")


def text_stats(b: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then lines, capitals, digits, points and distinct words."""
    words = b.split()  # of bytes: at space and \x09-\x0D alone
    if not words:
        return (0,) * 10
    raw = np.frombuffer(b, np.uint8)
    count = np.bincount(raw, minlength=256)
    chars = len(raw) - int(count[128:192].sum()) - int(count[_SPACE].sum())
    kinds = [int(count[_CLASS[k]].sum()) for k in range(4)]
    lines = [x for x in b.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeated = 0
    if len(codes) >= 4:
        k, n = len(ids), len(codes)
        pair = np.unique(codes[:-1] * k + codes[1:], return_inverse=True)[1]  # dense codes: exact, with no hashing
        _, inv, times = np.unique(pair[:-1] * k + codes[2:], return_inverse=True, return_counts=True)
        hit = times[inv] > 1
        over = np.zeros(n, bool)
        for d in range(3):
            over[d : n - 2 + d] |= hit
        repeated = int(over.sum())
    return (len(words), chars, kinds[0], len(lines) - len(set(lines)), repeated, len(lines), kinds[1], kinds[2], kinds[3], len(ids))


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the statistics of the last column's texts to the others, a slice of text at a time."""
    for batch in it:
        for part in slices(batch, batch.num_columns - 1):
            rows = np.array([text_stats(x or b"") for x in utf8(part.column(part.num_columns - 1))], np.int64).reshape(-1, 10)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(rows[:, k]) for k in range(10))], names=[*part.schema.names[:-1], *_NAMES])


def _based(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text, and base_failed. A null text has no words and fails."""
    docs = long_doc(docs)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", *_NAMES)])
    return _based(docs.mapInArrow(_batches, schema))


@dataclass(frozen=True)
class Rule:
    """Rejects where every condition (feature, at_least, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    wrong: int

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {'>=' if up else '<='} {t!r}D" for f, up, t in self.conditions)


def _holds(x: dict[str, np.ndarray], conditions) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for f, up, t in conditions:
        out &= x[f] >= t if up else x[f] <= t
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: int):
    """The condition that adds most information about ``bad`` rows among those inside."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
    for f, v in x.items():
        val, y = v[inside], bad[inside]
        order = np.argsort(val, kind="stable")
        val, y = val[order], y[order]
        at = np.flatnonzero(val[1:] > val[:-1]) + 1  # a cut stands between two values
        if len(at) > cuts:
            at = at[np.linspace(0, len(at) - 1, cuts).astype(int)]
        below = np.concatenate([[0], np.cumsum(y)])
        for k in at:
            mid = float((val[k] + val[k - 1]) / 2)
            for up, p, m in ((False, below[k], k), (True, p0 - below[k], len(y) - k)):
                if p and (gain := p * (math.log2(p / m) - base)) > best[0] + 1e-12:
                    best = (gain, (f, up, mid))
    return best[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, least_precision: float = 0.9, least_cover: int = 5, rules: int = 16, conditions: int = 4, cuts: int = 256, seed: int = 7) -> list[Rule]:
    """Sequential covering of the ``bad`` rows by rules.

    A rule stands only if on the rows held out for pruning it is right for at least ``least_precision`` of what it
    covers, by the lower end of its 90 % Wilson interval where few are covered, so that clean documents stay.
    No labelled rows, or labels of one kind, give no rules.
    """
    n, found = len(bad), []
    if not n or not bad.any() or bad.all():
        return found
    prune = np.random.default_rng(seed).random(n) < 1 / 3
    left = np.ones(n, bool)
    while len(found) < rules and (bad & left & ~prune).any():
        grown, inside = [], left & ~prune
        while len(grown) < conditions and (~bad[inside]).any() and (c := _best(x, bad, inside, cuts)):
            grown.append(c)
            inside = inside & _holds(x, [c])
        if not grown:
            break

        def worth(cond):
            hit = _holds(x, cond) & left & prune
            p, m = int((hit & bad).sum()), int(hit.sum())
            return ((2 * p - m) / m if m else -1.0), p, m

        value = worth(grown)
        while len(grown) > 1 and (shorter := worth(grown[:-1]))[0] >= value[0]:
            grown, value = grown[:-1], shorter
        hit = _holds(x, grown) & left
        p, m = int((hit & bad).sum()), int(hit.sum())
        right, seen = value[1:]
        if m < least_cover or not seen or right / seen < least_precision or p / m < least_precision or seen < 30 and _wilson(right, seen) < least_precision - 0.25:
            break
        found.append(Rule(tuple(grown), m, m - p))
        left &= ~hit
    return found


def _wilson(p: int, m: int, z: float = 1.2816) -> float:
    q = p / m
    return (q + z * z / (2 * m) - z * math.sqrt(q * (1 - q) / m + z * z / (4 * m * m))) / (1 + z * z / m)


def decision_list(rules: list[Rule]) -> Column:
    """The ordered rules as one expression: the number of the first rule that rejects, from 1; null: none does."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("case " + " ".join(f"when {r.sql()} then {k}" for k, r in enumerate(rules, 1)) + " end").cast("int")


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, _quality) of at most ``sample`` labelled documents, the first by a hash of the id.

    A threshold on the hash, from the number of labelled documents, leaves about that many rows before any of them are ordered, so that no
    more than these meet in one place.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_quality")).dropna().groupBy("doc_id").agg(F.min("_quality").alias("_quality"))
    rows = rows.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi").withColumn("_key", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    n = rows.count()
    if n > sample:
        share = (sample + 4 * math.sqrt(sample)) / n
        rows = rows.where(F.col("_key") <= int(min(1.0, share) * (1 << 63)) - 1)  # a share of 1 must still be a long
    return rows.orderBy("_key", "doc_id").limit(sample).select("doc_id", "_quality")


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, **options) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents; of these, the ones that pass the base rules.

    Null labels and ids take no part; of two labels for one id the lower quality counts. ``cuts`` (256) is the number of thresholds tried for a
    feature, spread evenly over the values found. Statistics are taken of the sampled texts alone.
    """
    docs = long_doc(docs)
    picked = _sampled(docs, labels, sample)
    stats = document_stats(docs.join(F.broadcast(picked.select("doc_id")), "doc_id"))  # no more rows than ``sample``
    table = stats.where("not base_failed").join(F.broadcast(picked), "doc_id").select("doc_id", "_quality", *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items())).toPandas()
    table = table.sort_values("doc_id", kind="stable")
    return learn({f: table[f].to_numpy(float) for f in FEATURES}, (table["_quality"] == 0).to_numpy(bool), **options)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: its statistics, base_failed, rule (the list's rule that rejects it) and kept.

    Empty and null texts have no words, fail the base rules and are not kept. Repeated ids give a row each.
    Other columns of ``docs`` and ``labels`` are not looked at, whatever their names. Texts are read whole.
    """
    rules = fit(docs, labels, **options)
    return document_stats(docs).withColumn("rule", F.when(~F.col("base_failed"), decision_list(rules))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, whole and with their columns.

    Rows travel beside their statistics as one struct, so that ids may be null or repeat and no text is shuffled.
    """
    rules = fit(docs, labels, **options)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(text).cast("string").alias("_of"))
    schema = T.StructType([rows.schema["_row"], *(T.StructField(c, T.LongType()) for c in _NAMES)])
    judged = _based(rows.mapInArrow(_batches, schema))
    return judged.where(~F.col("base_failed") & decision_list(rules).isNull()).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
