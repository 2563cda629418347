"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test string is a run of ``width`` words of an item. A table of shifts, by the hash of a block of two words, says how far a search
may go on from a place: no test string can end in between. Where it says 0, the bucket of test strings that end with the same two
words is searched by the hash of the whole string, and what is found is confirmed by comparing all its letters. Items of fewer words
are test strings of their own length, each length with a table of its own. Places are searched in many lanes at once, and words
are hashed only where a lane stops.

Items travel to the tasks in groups of bounded size, which the tasks index themselves; each group reads the documents once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, mix, slices, utf8

#: Bytes of items that a task holds at a time, and places of a lane.
GROUP_BYTES, LANE = 4 << 20, 256
_KIND = np.zeros(256, bool)
_KIND[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SPANS = "array<struct<start: long, end: long>>"


class Words:
    """The words of some texts, in lower case: where each starts and ends, the text it stands in, and hashes on demand."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.data = _LOWER[np.frombuffer(b"\n".join([b"", *texts, bytes(8)]), np.uint8)]
        inside = _KIND[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[::2], edges[1::2]
        heads = np.cumsum(np.r_[1, sizes])
        self.before = np.searchsorted(self.start, heads)  # words before each text, and in all
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.before))
        self._eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))

    def key(self, k: np.ndarray) -> np.ndarray:
        """Hash of words by their first and last eight bytes and their length; letters are compared afterwards."""
        start, end = self.start[k], self.end[k]
        mask = _MASK[np.minimum(end - start, 8)]
        out = (self._eight[start] & mask) * _A
        out += (self._eight[np.maximum(end - 8, start)] & mask) * _B
        out += (end - start).astype(np.uint64) * _C
        return mix(out)

    def block(self, last: np.ndarray, size: int) -> np.ndarray:
        out = self.key(last)
        return out if size == 1 else mix(out + self.key(last - 1) * _A)

    def whole(self, last: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(last), np.uint64)
        for k in range(size):
            out = out * _A + self.key(last - k)
        return mix(out)


def _letters(words: Words, last: np.ndarray, size: int, lengths: np.ndarray) -> np.ndarray:
    """All bytes of runs of ``size`` words that end at ``last``, run after run; ``lengths`` are the words' own."""
    first = (last[:, None] - np.arange(size - 1, -1, -1)).ravel()
    total = lengths.ravel()
    at = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    return words.data[np.repeat(words.start[first], total) + at]


def same(a: Words, last_a: np.ndarray, b: Words, last_b: np.ndarray, size: int) -> np.ndarray:
    """Whether the runs of ``size`` words that end there are equal, letter by letter."""
    back = np.arange(size - 1, -1, -1)
    length = lambda w, last: (w.end - w.start)[last[:, None] - back]
    len_a, len_b = length(a, last_a), length(b, last_b)
    out = (len_a == len_b).all(axis=1)
    if out.any():
        len_a = len_a[out]
        equal = _letters(a, last_a[out], size, len_a) == _letters(b, last_b[out], size, len_a)
        runs = len_a.sum(axis=1)
        out[out] = np.logical_and.reduceat(equal, np.cumsum(runs) - runs)
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ..., of each start and size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class Table:
    """Shifts and buckets of the test strings of one length."""

    size: int
    block: int
    shift: np.ndarray
    tails: np.ndarray
    names: np.ndarray
    last: np.ndarray
    items: np.ndarray  # items of all test strings, those of string k from first[k] to first[k + 1]
    first: np.ndarray

    @staticmethod
    def name(bucket: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Sorts by bucket, then by the hash of the whole string."""
        return (bucket.astype(np.uint64) << np.uint64(36)) | (whole >> np.uint64(28))

    @classmethod
    def of(cls, words: Words, last: np.ndarray, item: np.ndarray, size: int) -> Table:
        block = min(2, size)
        bits = int(np.clip(np.ceil(np.log2(16.0 * len(last) * size)), 10, 24))
        shift = np.full(1 << bits, size - block + 1, np.uint8)
        for back in range(size - block, -1, -1):  # the nearest to the end last, so that the least shift stays
            shift[words.block(last - back, block) >> np.uint64(64 - bits)] = back
        tail = words.block(last, block)
        tails, bucket = np.unique(tail, return_inverse=True)
        name = cls.name(bucket, words.whole(last, size))
        order = np.argsort(name, kind="stable")
        name, last, item = name[order], last[order], item[order]
        head = np.searchsorted(name, name)  # the first string of that name
        alike = same(words, last, words, last[head], size)
        string = np.where(alike, head, np.arange(len(name)))
        pairs = np.unique(np.stack([string, item], axis=1), axis=0)
        kept, first = np.unique(pairs[:, 0], return_index=True)
        return cls(size, block, shift, tails, name[kept], last[kept], pairs[:, 1], np.r_[first, len(pairs)])


class Search:
    """Search for all test strings of a group of items."""

    def __init__(self, texts: list[bytes], width: int):
        self.words = Words(texts)
        count = np.diff(self.words.before)
        self.tables = []
        for size in range(1, width + 1):
            own = np.flatnonzero(count == size if size < width else count >= width)
            if len(own):
                windows = count[own] - size + 1
                last = _runs(self.words.before[own] + size - 1, windows)
                self.tables.append(Table.of(self.words, last, np.repeat(own, windows), size))

    def occurrences(self, words: Words, table: Table, stops: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(last word, test string) of every occurrence in ``words``; ``stops``, if given, gets the number of places looked at."""
        n, bits = len(words.start), np.uint64(64 - int(np.log2(len(table.shift))))
        lane = np.arange(0, n, LANE)
        at, end = np.maximum(lane, table.size - 1), np.minimum(lane + LANE, n)
        at, end = at[at < end], end[at < end]
        found, tails = [], []
        while len(at):
            tail = words.block(at, table.block)
            shift = table.shift[tail >> bits].astype(np.int64)
            if stops is not None:
                stops.append(len(at))
            here = shift == 0
            if here.any():
                found.append(at[here])
                tails.append(tail[here])
            at = at + np.maximum(shift, 1)
            more = at < end
            at, end = at[more], end[more]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last, tail = np.concatenate(found), np.concatenate(tails)
        bucket = np.searchsorted(table.tails, tail)
        known = words.row[last - table.size + 1] == words.row[last]
        known &= table.tails[np.minimum(bucket, len(table.tails) - 1)] == tail
        last, bucket = last[known], bucket[known]
        name = table.name(bucket, words.whole(last, table.size))
        low, high = np.searchsorted(table.names, name), np.searchsorted(table.names, name, side="right")
        last, string = np.repeat(last, high - low), _runs(low, high - low)
        true = same(words, last, self.words, table.last[string], table.size)
        return last[true], string[true]

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each text: words, covered runs of words as [start, end) and the numbers of the items that occur."""
        words = Words(texts)
        n = len(words.start)
        cover, hits = np.zeros(n + 1, np.int64), [np.zeros((0, 2), np.int64)]
        for table in self.tables:
            last, string = self.occurrences(words, table)
            np.add.at(cover, last - table.size + 1, 1)
            np.add.at(cover, last + 1, -1)
            met = np.unique(np.stack([words.row[last], string], axis=1), axis=0)
            sizes = table.first[met[:, 1] + 1] - table.first[met[:, 1]]
            hits.append(np.stack([np.repeat(met[:, 0], sizes), table.items[_runs(table.first[met[:, 1]], sizes)]], axis=1))
        hit = np.cumsum(cover)[:n] > 0
        edge = np.ones(n + 1, bool)
        edge[1:n] = (hit[1:] != hit[:-1]) | (words.row[1:] != words.row[:-1])
        edges = np.flatnonzero(edge)
        start, end = edges[:-1][hit[edges[:-1]]] if n else edges[:0], edges[1:][hit[edges[:-1]]] if n else edges[:0]
        hits = np.unique(np.concatenate(hits), axis=0)
        row = words.row[start] if len(start) else start
        spans = np.stack([start - words.before[row], end - words.before[row]], axis=1)
        by_row = lambda rows: np.searchsorted(rows, np.arange(len(texts) + 1))
        s, i = by_row(row), by_row(hits[:, 0])
        return [(int(words.before[k + 1] - words.before[k]), spans[s[k] : s[k + 1]], hits[i[k] : i[k + 1], 1]) for k in range(len(texts))]


def pieces_of(text: bytes, width: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, bytes]]:
    """(words before it, piece) of a long text: pieces share ``width`` - 1 words, so that each window is whole in one of them."""
    at = before = 0
    while len(text) - at > limit:
        size = limit
        while True:
            gap = _GAP.search(text, at + size)
            stop = gap.start() if gap else len(text)
            words = Words([text[at:stop]])
            if len(words.start) >= width or stop == len(text):
                break
            size = stop - at + limit
        yield before, text[at:stop]
        if stop == len(text):
            return
        back = len(words.start) - width + 1
        before += back
        at += int(words.start[back] if width > 1 else words.end[-1] + 1) - 1  # the words' own data begins with a line end
    yield before, text[at:]


def joined(spans: np.ndarray) -> np.ndarray:
    """Spans in order, those that touch or overlap made one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], axis=1)


_SEARCHES: dict[bytes, Search] = {}


def _search(texts: list[bytes], width: int) -> Search:
    """The search of a group, which each worker makes once."""
    name = hashlib.sha256(b"%d\0" % width + b"\n\0".join(texts)).digest()
    if name not in _SEARCHES:
        _SEARCHES.clear()
        _SEARCHES[name] = Search(texts, width)
    return _SEARCHES[name]


def _span_column(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros((0, 2), np.int64), *rows])
    inner = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), inner)


def _scanner(texts: list[bytes], names: list[str | None], width: int):
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(texts, width)
        for batch in it:
            for part in slices(batch, batch.num_columns - 1):
                rows = [t or b"" for t in utf8(part.column(part.num_columns - 1))]
                if len(rows) == 1 and len(rows[0]) > SLICE_BYTES:
                    found = [_long(search, rows[0], width)]
                else:
                    found = search.scan(rows)
                items = [sorted({names[k] for k in hit if names[k] is not None}) for _, _, hit in found]
                columns = [pa.array([n for n, _, _ in found], pa.int64()), _span_column([s for _, s, _ in found]), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], "n_words", "spans", "items"])

    return scan


def _long(search: Search, text: bytes, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    spans, hits, total = [], [], 0
    for before, piece in pieces_of(text, width):
        n, span, hit = search.scan([piece])[0]
        spans.append(span + before)
        hits.append(hit)
        total = before + n
    return total, joined(np.concatenate(spans)), np.unique(np.concatenate(hits))


def _cutter(width: int, limit: int):
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                # What is left of a long item may be only the words shared with the piece before: no test string of its own.
                rows = [piece for before, piece in pieces_of(text or b"", width, limit) if not before or len(Words([piece]).start) >= width]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.binary())], names=["item", "piece"])

    return cut


def _joiner(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in it:
        at = batch.schema.get_field_index("spans")
        rows = [joined(np.array([(s["start"], s["end"]) for s in x], np.int64).reshape(-1, 2)) for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, "spans", _span_column(rows))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of ``docs``: the runs of its words that stand in occurrences of test strings, and whose.

    A word is a run of digits, of letters a-z once A-Z are in lower case, and of anything beyond ASCII. Test strings are ``width``
    consecutive words of an item, or the whole item where it has fewer; items without words have none. ``spans`` are [start, end) by word
    number, apart from each other; ``items`` are ids as strings, in their order. A null or empty text has no words; rows without an id
    and repeated rows are searched like all others. Rows of an id make one item; test strings of items without an id are searched
    too, and named nowhere. Other columns play no part. The benchmark is dealt into groups of ``group_bytes``, each of which reads the documents.
    """
    spark = docs.sparkSession
    strings = benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull())
    parts = strings.mapInArrow(_cutter(width, max(1, group_bytes // 4)), "item string, piece binary")
    total = parts.agg(F.coalesce(F.sum(F.length("piece") + 16), F.lit(0))).first()[0]
    groups = int(total // group_bytes) + 1
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("item", "piece"), F.lit(groups)))
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if groups > 1:
        whole = whole.select("doc_id", F.md5("text").alias("mark"), "text")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema[:-1]), f"n_words long, spans {SPANS}, items array<string>"])
    found = []
    for g in range(groups):
        rows = sorted((r["item"] or "", bytes(r["piece"]), r["item"]) for r in dealt.where(F.col("g") == g).collect())
        found.append(whole.mapInArrow(_scanner([r[1] for r in rows], [r[2] for r in rows], width), schema))
    if groups == 1:
        return found[0]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    lists = lambda c: F.flatten(F.collect_list(c))
    met = every.groupBy("doc_id", "mark", "n_words").agg(lists("spans").alias("spans"), F.array_sort(F.array_distinct(lists("items"))).alias("items"), (F.count("*") / groups).cast("int").alias("rows"))
    single = met.mapInArrow(_joiner, met.schema)
    return single.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("rows")))).select("doc_id", "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """Words within ``spans``."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
