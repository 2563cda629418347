"""Spelling variant grouping by a bit-sliced position index.

A block of words is held as bit sets: for each place and letter, which words have that letter there. A word asks letter by letter, and
three sets of bits move at once: words that agree so far, words that agree but for one replaced letter, and words that agree but for
one letter more, which are read one place further on. So one step of 64-bit operations asks a whole block; a word with a letter less
is the same pair, asked from its side.

Two words a single edit apart share either the first or the last half of the shorter one. Words are dealt by their length and
these halves, so that only likely words stand in one block; a group that is too large is dealt again by half of what
is left, down to words that agree in all but one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions

#: Words of a block, of a group that is dealt again, and rows of a task.
BLOCK, HOT, TASK_ROWS = 1_024, 8_192, 500_000
_KEY = ("m", "a", "b", "path", "k")


def letters(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters as numbers, a row for each word, 0 beyond its end; lengths)."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.zeros((len(words), width), np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat + 1
    return out, sizes


class Index:
    """For each place and letter the set of words that have it there, as rows of 64-bit numbers."""

    def __init__(self, table: np.ndarray):
        self.n = len(table)
        self.wide = -(-self.n // 64)
        self.names, self.bits = [], []
        for place in range(table.shape[1]):
            name, code = np.unique(table[:, place], return_inverse=True)
            on = np.zeros((len(name) + 1, self.wide * 64), bool)
            on[code, np.arange(self.n)] = True
            on[:-1][name == 0] = False  # beyond the end of a word stands no letter
            self.names.append(name)
            self.bits.append(np.packbits(on, axis=1, bitorder="little").view(np.uint64))

    def at(self, place: int, letter: np.ndarray) -> np.ndarray:
        """A set of words for each letter: those that have it at ``place``."""
        name = self.names[place]
        k = np.minimum(np.searchsorted(name, letter), len(name) - 1)
        return self.bits[place][np.where(name[k] == letter, k, len(name))]

    def packed(self, which: np.ndarray) -> np.ndarray:
        return np.packbits(np.r_[which, np.zeros(self.wide * 64 - self.n, bool)], bitorder="little").view(np.uint64)


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of all bits that are set."""
    row, word = np.nonzero(sets)
    which, bit = np.nonzero(np.unpackbits(sets[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[which], word[which] * 64 + bit


def near(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words one edit apart, both ways round, of which one at least has ``m`` letters and none more than m + 1."""
    table, sizes = letters(words, m + 1)
    asks = np.flatnonzero(sizes == m)
    if not len(asks) or len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = Index(table)
    equal, longer = index.packed(sizes == m), index.packed(sizes == m + 1)
    left, right = [], []
    for at in range(0, len(asks), BLOCK):
        own = asks[at : at + BLOCK]
        agree = np.full((len(own), index.wide), np.uint64(0xFFFFFFFFFFFFFFFF))
        replaced, added = np.zeros_like(agree), np.zeros_like(agree)
        for place in range(m):
            letter = table[own, place]
            here = index.at(place, letter)
            added = (added | agree) & index.at(place + 1, letter)
            replaced = (replaced & here) | (agree & ~here)
            agree &= here
        i, j = _members(replaced & equal)
        left.append(own[i])
        right.append(j)
        i, j = _members((added | agree) & longer)
        left += [own[i], j]
        right += [j, own[i]]
    return np.concatenate(left), np.concatenate(right)


def paths(prefix: np.ndarray, m: int, depth: int) -> np.ndarray:
    """The path of a pair that agrees in so many first letters: 1, then for each step 0 if it shares the first half of what is left, else 1."""
    a, b, path = np.zeros_like(prefix), np.zeros_like(prefix), np.ones_like(prefix)
    for _ in range(depth):
        step = (m - a - b) // 2
        first = prefix >= a + step
        a, b, path = np.where(first, a + step, a), np.where(first, b, b + step), 2 * path + ~first
    return path


def _pairs(words: list[str], m: int, path: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of a block of groups of this path; a pair may meet in groups of others too, but only one path is its own."""
    i, j = near(words, m)
    if not len(i):
        return i, j
    table, _ = letters(words, m + 1)
    differ = table[i, :m] != table[j, :m]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
    keep = paths(prefix, m, path.bit_length() - 1) == path
    return i[keep], j[keep]


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str], list[int]]]:
    """Whole groups of sorted rows, as many of one kind as make a block."""
    kind, words, counts, last = None, [], [], None
    for batch in it:
        columns = [batch.column(c).to_pylist() for c in (*_KEY, "word", "n")]
        for m, _, _, path, k, word, n in zip(*columns, strict=True):
            if (m, path) != kind or k != last:
                if words and ((m, path) != kind or len(words) >= BLOCK):
                    yield kind, words, counts
                    words, counts = [], []
                kind, last = (m, path), k
            words.append(word)
            counts.append(n)
    if words:
        yield kind, words, counts


def _neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (m, path), words, counts in _blocks(it):
        i, j = _pairs(words, m, path)
        if len(i):
            name, n = pa.array(words, pa.string()), pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([name.take(pa.array(i)), name.take(pa.array(j)), n.take(pa.array(j))], names=["word", "other", "other_n"])


_SHARED = "concat_ws(' ', substring(word, 1, a), substring(word, char_length(word) - b + 1, b))"


def near_words(words: DataFrame, *, hot: int = HOT) -> DataFrame:
    """(word, other, other_n): all pairs of different words of (word, n) that one inserted, deleted or replaced code point makes equal.

    Each pair comes both ways round and once each. A word has few neighbours whatever the size of the table: as many as there are places times letters.
    """
    length = F.char_length("word")
    own = words.select("word", "n").where("word is not null and word <> ''")
    sides = F.explode(F.expr("sequence(greatest(char_length(word) - 1, 1), char_length(word))"))
    rows = own.withColumn("m", sides).withColumn("half", F.expr("m div 2")).withColumn("first", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.where("first or half > 0").selectExpr("word", "n", "m", "if(first, half, 0) as a", "if(first, 0, half) as b", "if(first, 2, 3) as path").withColumn("k", F.expr(_SHARED))
    n = own.count()
    longest = own.agg(F.max(length)).first()[0] or 0
    done = None
    while True:
        # A kind of one place left over has few words; others are dealt again where they are many.
        full = cut(rows.where("m - a - b >= 2").groupBy(*_KEY).count().where(F.col("count") > hot).select(*_KEY), "variant-groups")
        again = full.limit(1).count() > 0 and longest > 1
        part = rows.join(full, list(_KEY), "left_anti") if again else rows
        part = part.select(*_KEY, "word", "n")
        done = part if done is None else done.unionByName(part)
        if not again:
            break
        large = rows.join(full, list(_KEY), "left_semi").withColumn("half", F.expr("(m - a - b) div 2"))
        large = large.withColumn("first", F.explode(F.array(F.lit(True), F.lit(False))))
        large = large.selectExpr("word", "n", "m", "if(first, a + half, a) as a", "if(first, b, b + half) as b", "2 * path + if(first, 0, 1) as path")
        rows = cut(large.withColumn("k", F.expr(_SHARED)), "variant-rows")
    dealt = done.repartition(partitions(words.sparkSession, 4 * n, TASK_ROWS), *_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(_neighbours, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling: each round goes twice as far as the one before."""
    cur = cut(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = cut(cur.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not nxt.where("moved").limit(1).count():
            return nxt.select("word", "root")
        cur = nxt.select("word", "root")


def group_variants(words: DataFrame, *, ratio: int = 10, word: str = "word", n: str = "n", hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table of words and their counts.

    A word's form is its near word of the largest count, ties to the first in code-point order, if that count is at least ``ratio`` (over
    1) times the word's own; the root is where forms lead to, or the word itself. Rows that repeat a word add up; null and empty words and
    null counts are left out; other columns play no part. An empty table gives no rows.
    """
    own = words.select(F.col(word).cast("string").alias("word"), F.col(n).cast("long").alias("n"))
    own = cut(own.where("word <> '' and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "variant-words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best")
    met = near_words(own, hot=hot).groupBy("word").agg(F.count("*").alias("n_near"), best)
    right = F.expr(f"-best.n >= {int(ratio)} * n")
    joined = own.join(met, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(right, F.col("best.form")).alias("form"), F.when(right, -F.col("best.n")).alias("form_n"))
    joined = cut(joined, "variant-forms")
    out = joined.join(_roots(joined.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_letters: int = 7, least_n: int = 2, slip: int | None = 31) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0-U+00FF of all texts, A-Z in lower case, with so many letters and occurrences at least.

    With ``slip``, occurrences are misspelled on purpose: where it divides the crc32 h of ``<doc_id>:<run>``, the letter at h % length, from
    0, is left out before runs are counted. A null text has no runs; a null id is written as nothing; repeated rows count each.
    """
    run = F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}+"), F.lit(0)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), run.alias("w"))
    runs, word = runs.select("d", F.translate("w", upper, upper.lower()).alias("w")), F.col("w")
    if slip:
        h = F.crc32(F.encode(F.concat("d", F.lit(":"), "w"), "UTF-8"))
        runs = runs.select("w", h.alias("h"))
        short = F.expr("concat(substring(w, 1, cast(h % char_length(w) as int)), substring(w, cast(h % char_length(w) as int) + 2))")
        word = F.when(F.col("h") % slip == 0, short).otherwise(word)
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)
