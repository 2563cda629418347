"""What both substring operators share: bringing all places of a repeated window together, and removing what they find.

A window is ``width`` consecutive units (words or bytes) of one document. Its anchor is the leftmost least of the hashes of its runs of
``gram`` units, so equal windows have equal anchors at equal places. Consecutive windows of one anchor form a run.

0. Of documents with equal texts the one of the smallest id stands for all; the others go whole, if they have a window.
1. Anchors are counted in groups by hash; those that only one text has can hold no repeat. Anchors are packed as 32-bit numbers. What many
   texts of one slice have is known to be shared there and then, and only one of them is sent on.
2. Of the others, each run travels as one segment (its windows' units, its document and place) to its anchor's group. There a structure over
   the distinct segments - the part that the two operators do their own way - tells for each window the smallest document that has it. Windows
   of different anchors are different, so that an anchor with one distinct segment needs no structure. Of equal segments in a slice only
   those of the smallest document travel: the windows of the others start in it. So what stands inside a common passage
   comes once from a slice; at its edges each document has a segment of its own.
3. The distinct segments of one anchor may be more than a task should hold. They are then cut into pieces, of windows whose anchor is
   about as far from their start, and dealt again by a longer stretch that all windows of a piece share: half a window, nearly all of
   it, and in the end the window itself (``levels``). Equal windows lie in pieces of one key, so that nothing is lost, and the structure
   works on each key's pieces as before. What very many texts have is dealt so from the start.
4. Each document's windows that start in a smaller one meet its text, and the units that they cover go.

The text is shuffled once: both joins with it use one exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, long_doc, mix, partitions, raw, slices, window_hash

_PLACE = np.uint64((1 << 26) - 1)
#: Anchors, and units of segments, that one group holds on average.
GROUP_ANCHORS, GROUP_UNITS = 4_000_000, 3_000_000
#: Texts of a slice from which an anchor is answered there, and texts in all from which its runs are dealt in pieces at once. Of the
#: latter there are no more than the input's anchors by this number: 50 MB of names for 100 TB, broadcast once.
HEAVY, BIG = 16, 1_000_000
#: Units of the distinct segments of one key that a structure takes. A task looks for larger keys when it holds ``HOLD`` times as many units.
LIMIT, HOLD = 1 << 20, 16


@dataclass(frozen=True)
class Units:
    """How texts become units - (values, units before each row) from bytes and ends - and how those that are not gone become bytes again."""

    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    join: Callable[[bytes, np.ndarray], bytes]
    dtype: str
    width: int
    gram: int


def runs(units: np.ndarray, before: np.ndarray, kind: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor hash, anchor's place) of every run; places count along ``units``."""
    n, reach = len(units), kind.width - kind.gram + 1
    none = (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if n < kind.width:
        return none
    grams = window_hash(units, kind.gram)
    key = (grams & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
    step = 1
    while step * 2 <= reach:
        key[: n - step] = np.minimum(key[: n - step], key[step:])
        step *= 2
    last = n - kind.width + 1
    least = np.minimum(key[:last], key[reach - step : reach - step + last])
    start = np.arange(last)
    anchor = start + (((least & _PLACE).astype(np.int64) - start) & int(_PLACE))
    many = np.maximum(np.diff(before) - kind.width + 1, 0)  # windows of each row
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(row)) + np.repeat(before[:-1] - np.cumsum(many) + many, many)
    if not len(at):
        return none
    anchor = anchor[at]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    return row[first], at[first], np.diff(np.r_[first, len(at)]), grams[anchor[first]], anchor[first]


def levels(width: int) -> list[tuple[int, int]]:
    """(windows of a piece, units of its key) for each time that a key's segments are dealt again."""
    c = max(1, width // 6)
    return [(c, max(1, width // 2)), (c, width - c + 1), (1, width)]


def pieces(units: np.ndarray, at: np.ndarray, many: np.ndarray, place: np.ndarray, level: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, windows, key) of the pieces of runs, whose anchors are at ``place``.

    Piece k of a run has the windows that start at least k * c and less than (k + 1) * c units before the anchor. Each of them contains the
    units from k * c before the anchor on, as far as its key reaches, so that equal windows have one key.
    """
    c, reach = level
    run = np.repeat(np.arange(len(at)), many)
    window = np.repeat(at - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    k = (place[run] - window) // c
    first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (k[1:] != k[:-1])][: len(run)])
    run, k = run[first], k[first]
    key = mix(window_hash(units, reach)[place[run] - k * c] ^ k.astype(np.uint64)) if len(run) else np.zeros(0, np.uint64)
    return run, window[first], np.diff(np.r_[first, len(window)]), key


def _group_of(anchor: np.ndarray, groups: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _split(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for a, b in zip(starts, np.r_[starts[1:], len(group)] if len(group) else [], strict=True):
        yield int(group[a]), slice(int(a), int(b))


_ANCHORS = "kind int, g int, docs binary, counts binary, keys binary, times binary"


def _anchors(kind: Units, groups: int):
    """Rows of anchors by group: (text hashes, anchors of each, low 32 bits of the anchors, in how many texts each is for sure).

    Rows of kind 0 hold a text hash and those of its anchors that are known to be shared, whole.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                units, before = kind.read(*raw(part.column(1)))
                row, _, _, anchor, _ = runs(units, before, kind)
                texts, of = np.unique(np.asarray(part.column(0), np.int64), return_inverse=True)
                group = _group_of(anchor, groups)
                whole = (group.astype(np.uint64) << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))
                order = np.lexsort((of[row], whole))
                whole, text = whole[order], of[row][order]
                keep = np.r_[True, (whole[1:] != whole[:-1]) | (text[1:] != text[:-1])][: len(whole)]
                whole, text = whole[keep], text[keep]
                start = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]][: len(whole)])
                many = np.diff(np.r_[start, len(whole)])
                heavy = np.repeat(many >= HEAVY, many)
                first = np.zeros(len(whole), bool)
                first[start] = True
                out = {"kind": [], "g": [], "docs": [], "counts": [], "keys": [], "times": []}
                at = np.flatnonzero(heavy)
                at = at[np.argsort(text[at], kind="stable")]
                for t, s in _split(text[at]):
                    row_of = (0, int(t) % groups, texts[[t]], np.array([s.stop - s.start], np.uint32), whole[at[s]], np.zeros(0, np.uint32))
                    for c, x in zip(out.values(), row_of, strict=True):
                        c.append(x if isinstance(x, int) else x.tobytes())
                send = first | ~heavy
                whole, text, times = whole[send], text[send], np.where(heavy, np.repeat(many, many), 1)[send].astype(np.uint32)
                group = (whole >> np.uint64(32)).astype(np.int64)
                order = np.argsort(group * max(1, len(texts)) + text, kind="stable")
                group, text, low, times = group[order], text[order], whole[order].astype(np.uint32), times[order]
                for g, s in _split(group):
                    some, counts = np.unique(text[s], return_counts=True)
                    row_of = (1, g, texts[some], counts.astype(np.uint32), low[s], times[s])
                    for c, x in zip(out.values(), row_of, strict=True):
                        c.append(x if isinstance(x, int) else x.tobytes())
                yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int32()) for c in ("kind", "g")), *(pa.array(out[c], pa.binary()) for c in list(out)[2:])], names=list(out))

    return run


def _by_group(it: Iterator[pa.RecordBatch], done, at_once) -> Iterator[pa.RecordBatch]:
    """``done`` of the rows of each group, ``at_once`` of each row of kind 0; rows come sorted by ``kind`` and ``g``."""
    held, now = [], None
    for batch in it:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                yield from at_once(r)
                continue
            if now is not None and r["g"] != now:
                yield from done(now, held)
                held = []
            now = r["g"]
            held.append(r)
    if held:
        yield from done(now, held)


def _shared_anchors(big: int):
    """(text hash, keys) of the anchors that more than one text has; without a text hash, those that more than ``big`` texts have."""

    def rows(hashes: list, keys: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())], names=["hash", "keys"])

    def at_once(r):
        yield rows([int(np.frombuffer(r["docs"], np.int64)[0])], [r["keys"]])

    def done(g, held):
        docs = np.concatenate([np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in held])
        keys, times = (np.concatenate([np.frombuffer(r[c], np.uint32) for r in held]) for c in ("keys", "times"))
        order = np.lexsort((docs, keys))
        keys, docs, times = keys[order], docs[order], times[order].astype(np.int64)
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        named = lambda x: np.uint64(g) << np.uint64(32) | x.astype(np.uint64)
        common = np.add.reduceat(times, start) > big
        if common.any():
            yield rows([None], [named(keys[start[common]]).tobytes()])
        sure = np.repeat(np.maximum.reduceat(times, start) > 1, np.diff(np.r_[start, len(keys)]))
        keep = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]
        keys, docs, sure = keys[keep], docs[keep], sure[keep]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        many = np.repeat(np.diff(np.r_[start, len(keys)]) > 1, np.diff(np.r_[start, len(keys)])) | sure
        keys, docs = keys[many], docs[many]
        order = np.argsort(docs, kind="stable")
        keys, docs = keys[order], docs[order]
        parts = list(_split(docs))
        yield rows([d for d, _ in parts], [named(keys[s]).tobytes() for _, s in parts])

    return lambda it: _by_group(it, done, at_once)


def _equal_segments(units: np.ndarray, ends: np.ndarray, docs: np.ndarray, unit: int) -> np.ndarray:
    """Whether an equal segment of this slice has a smaller document; segments lie one after another in ``units``."""
    data, ids = units.tobytes(), {}
    stops = (ends * unit).tolist()
    seg = np.fromiter((ids.setdefault(data[a:b], len(ids)) for a, b in zip([0, *stops[:-1]], stops, strict=True)), np.int64, len(stops))
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, seg, docs)
    return docs > smallest[seg]


_SEGMENTS = "kind int, g int, docs binary, hashes binary, starts binary, windows binary, anchors binary, units binary"
_NAMES = [c.split()[0] for c in _SEGMENTS.split(", ")]


def _dealt(kind: Units, groups: int, units: np.ndarray, at: np.ndarray, many: np.ndarray, key: np.ndarray, docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Rows (kind, group, documents, text hashes, places, windows, keys, units) of segments of ``units`` by the groups of their keys.

    Rows of kind 0 are segments of which an equal one here is of a smaller document: their windows go, and they have no units.
    """
    group = ((key >> np.uint64(16)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    at, many, key, group, docs, hashes, starts = (x[order] for x in (at, many, key, group, docs, hashes, starts))
    out = {c: [] for c in _NAMES}

    def packed(n, g, docs, hashes, starts, windows, keys, units):
        values = docs, hashes, starts.astype(np.int64), windows.astype(np.uint16), keys.astype(np.uint32), units.astype(kind.dtype)
        for c, x in zip(out.values(), (n, g, *(v.tobytes() for v in values)), strict=True):
            c.append(x)

    size = many + kind.width - 1
    flat = np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    content = units[flat].astype(kind.dtype)
    gone = _equal_segments(content, np.cumsum(size), docs, np.dtype(kind.dtype).itemsize) if len(size) else np.zeros(0, bool)
    if gone.any():
        none = np.zeros(0)
        packed(0, int(group[gone][0]), docs[gone], hashes[gone], starts[gone], many[gone], none, none)
        content = content[np.repeat(~gone, size)]
        docs, hashes, starts, many, key, group, size = (x[~gone] for x in (docs, hashes, starts, many, key, group, size))
    ends = np.r_[0, np.cumsum(size)]
    for g, s in _split(group):
        packed(1, g, docs[s], hashes[s], starts[s], many[s], key[s], content[ends[s.start] : ends[s.stop]])
    return pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int32()) for c in _NAMES[:2]), *(pa.array(out[c], pa.binary()) for c in _NAMES[2:])], names=_NAMES)


def _segments(kind: Units, groups: int, anchor_groups: int, big):
    """``_dealt`` of the runs whose anchors are shared; those of ``big``, a broadcast array of anchors, in pieces."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                units, before = kind.read(*raw(part.column(1)))
                row, at, many, anchor, place = runs(units, before, kind)
                docs, hashes = np.asarray(part.column(0), np.int64), np.asarray(part.column(3), np.int64)
                key = (_group_of(anchor, anchor_groups).astype(np.uint64) << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))
                keep = np.zeros(len(key), bool)
                edge = np.searchsorted(row, np.arange(len(docs) + 1))
                for k, lists in enumerate(part.column(2).to_pylist()):
                    if edge[k + 1] > edge[k]:
                        keep[edge[k] : edge[k + 1]] = np.isin(key[edge[k] : edge[k + 1]], np.frombuffer(b"".join(lists), np.uint64))
                row, at, many, anchor, key, place = (x[keep] for x in (row, at, many, anchor, key, place))
                if len(big.value) and (common := np.isin(key, big.value)).any():
                    of, at2, many2, anchor2 = pieces(units, at[common], many[common], place[common], levels(kind.width)[0])
                    row, at = np.r_[row[~common], row[common][of]], np.r_[at[~common], at2]
                    many, anchor = np.r_[many[~common], many2], np.r_[anchor[~common], anchor2]
                yield _dealt(kind, groups, units, at, many, anchor, docs[row], hashes[row], at - before[row])

    return run


def _runs_of(docs: np.ndarray, hashes: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """(doc_id, text hash, runs) from (first window, windows) of each document, in any order."""
    order = np.lexsort((hashes, docs))
    docs, hashes, pairs = docs[order], hashes[order], pairs[order]
    start = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])][: len(docs)])
    parts = [pairs[a:b].tobytes() for a, b in zip(start, np.r_[start[1:], len(docs)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(docs[start]), pa.array(hashes[start]), pa.array(parts, pa.binary())], names=["doc_id", "hash", "runs"])


_FOUND = f"doc_id long, hash long, runs binary, {_SEGMENTS}"


def _as_found(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of runs or of segments with the columns of both, null where it has none."""
    types = {"doc_id": pa.int64(), "hash": pa.int64(), "runs": pa.binary(), "kind": pa.int32(), "g": pa.int32()} | dict.fromkeys(_NAMES[2:], pa.binary())
    own = dict(zip(batch.schema.names, batch.columns, strict=True))
    return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(len(batch), t)) for c, t in types.items()], names=list(types))


class _Group:
    """The segments of one group: each distinct one once, and the places that have it.

    Segments of a key whose distinct ones have over ``limit`` units are passed on in pieces of ``finer``, all of them, those that have come and those to
    come; with ``finer`` None nothing is passed on, since there a key has one window.
    """

    def __init__(self, kind: Units, least, groups: int, finer: tuple[int, int] | None, limit: int, g: int):
        self.kind, self.least, self.groups, self.finer, self.limit, self.g = kind, least, groups, finer, limit, g
        self.ids: dict[bytes, int] = {}
        self.key, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # of each distinct segment, units for the size
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.places: list[np.ndarray] = []  # (segment, document, text hash, first window, windows)
        self.large, self.units, self.look = np.zeros(0, np.uint32), 0, HOLD * limit

    def add(self, r: dict) -> Iterator[pa.RecordBatch]:
        windows, keys = np.frombuffer(r["windows"], np.uint16).astype(np.int64), np.frombuffer(r["anchors"], np.uint32)
        docs, hashes, starts = (np.frombuffer(r[c], np.int64) for c in ("docs", "hashes", "starts"))
        size = windows + self.kind.width - 1
        ends, data = (np.cumsum(size) * np.dtype(self.kind.dtype).itemsize).tolist(), r["units"]
        parts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if len(self.large) and (out := np.isin(keys, self.large)).any():
            yield from self._finer([parts[k] for k in np.flatnonzero(out).tolist()], docs[out], hashes[out], starts[out], windows[out])
            parts = [parts[k] for k in np.flatnonzero(~out).tolist()]
            docs, hashes, starts, windows, keys, size = (x[~out] for x in (docs, hashes, starts, windows, keys, size))
        known, ids = len(self.ids), self.ids
        seg = np.fromiter((ids.setdefault(x, len(ids)) for x in parts), np.int64, len(parts))
        self.places.append(np.stack([seg, docs, hashes, starts, windows]))
        number, at = np.unique(seg, return_index=True)
        at = at[number >= known]
        self.new.append((keys[at], size[at]))
        self.units += int(size[at].sum())
        if self.finer and self.units > self.look:
            yield from self._pass_on()
            self.look = max(HOLD * self.limit, 2 * self.units)

    def _settle(self) -> None:
        self.key = np.concatenate([self.key, *(k for k, _ in self.new)])
        self.size = np.concatenate([self.size, *(n for _, n in self.new)])
        self.new, self.places = [], [np.concatenate(self.places, axis=1)] if self.places else []

    def _pass_on(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        names, of = np.unique(self.key, return_inverse=True)
        large = names[np.bincount(of, self.size, len(names)) > self.limit]
        if not len(large):
            return
        self.large = np.union1d(self.large, large)
        content, out = list(self.ids), np.isin(self.key, large)
        seg, *rest = self.places[0]
        gone = np.flatnonzero(out[seg])
        step = np.cumsum(self.size[seg[gone]]) // self.limit
        for _, s in _split(step):
            yield from self._finer([content[k] for k in seg[gone[s]].tolist()], *(x[gone[s]] for x in rest))
        number = np.cumsum(~out) - 1
        self.ids = {content[k]: int(number[k]) for k in np.flatnonzero(~out).tolist()}
        stay = self.places[0][:, ~out[seg]]
        stay[0] = number[stay[0]]
        self.places, self.key, self.size = [stay], self.key[~out], self.size[~out]
        self.units = int(self.size.sum())

    def _finer(self, parts: list[bytes], docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
        units = np.frombuffer(b"".join(parts), self.kind.dtype)
        before = np.r_[0, np.cumsum(windows + self.kind.width - 1)]
        row, at, many, _, place = runs(units, before, self.kind)  # one run each
        run, at, many, key = pieces(units, at, many, place, self.finer)
        row = row[run]
        yield _as_found(_dealt(self.kind, self.groups, units, at, many, key, docs[row], hashes[row], starts[row] + at - before[row]))

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.finer:
            yield from self._pass_on()
        else:
            self._settle()
        if not self.ids:
            return
        width, (seg, docs, hashes, starts, windows) = self.kind.width, self.places[0]
        smallest = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, seg, docs)
        distinct = [np.frombuffer(x, self.kind.dtype) for x in self.ids]
        per = self.size - width + 1
        base = np.cumsum(per) - per
        where = np.repeat(smallest, per)
        _, inverse, times = np.unique(self.key, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[inverse] > 1)
        several = several[np.argsort(inverse[several], kind="stable")]
        # Whole keys, as many at a time as have ``limit`` units.
        step = (np.cumsum(self.size[several]) - self.size[several]) // self.limit
        head = np.flatnonzero(np.r_[True, inverse[several][1:] != inverse[several][:-1]][: len(several)])
        step = np.repeat(step[head], np.diff(np.r_[head, len(several)]))
        for _, s in _split(step):
            some = several[s]
            n = per[some]
            at = np.repeat(base[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            where[at] = self.least([distinct[k] for k in some.tolist()], smallest[some], width)
        flat = np.repeat(base[seg] - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        place = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        occurrence = np.repeat(np.arange(len(docs)), windows)
        gone = where[flat] < docs[occurrence]
        place, occurrence = place[gone], occurrence[gone]
        if not len(place):
            return
        head = np.flatnonzero(np.r_[True, (occurrence[1:] != occurrence[:-1]) | (place[1:] != place[:-1] + 1)])
        who = occurrence[head]
        yield _as_found(_runs_of(docs[who], hashes[who], np.stack([place[head], np.diff(np.r_[head, len(place)])], axis=1)))


def _found(kind: Units, least: Callable[[list[np.ndarray], np.ndarray, int], np.ndarray], groups: int, finer: tuple[int, int] | None, limit: int):
    """(doc_id, text hash, runs of windows to remove) from the segments of each group, and pieces of the segments of keys too large.

    ``least(segments, documents, width)`` gives, for the windows of distinct segments one after another, the smallest document that has each.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    docs, hashes, starts = (np.frombuffer(r[c], np.int64) for c in ("docs", "hashes", "starts"))
                    yield _as_found(_runs_of(docs, hashes, np.stack([starts, np.frombuffer(r["windows"], np.uint16).astype(np.int64)], axis=1)))
                    continue
                if held is None or held.g != r["g"]:
                    if held is not None:
                        yield from held.done()
                    held = _Group(kind, least, groups, finer, limit, r["g"])
                yield from held.add(r)
        if held is not None:
            yield from held.done()

    return run


def _cleaned(kind: Units, text_column: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                data, ends = raw(part.column(1))
                _, before = kind.read(data, ends)
                data = data.tobytes()
                out = {"n": [], "gone": [], "spans": [], "sha": [], "text": []}
                for k, (lists, copy) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    text, n = data[ends[k] : ends[k + 1]], int(before[k + 1] - before[k])
                    gone = np.full(n, bool(copy) and n >= kind.width)
                    if lists and not copy:
                        pairs = np.frombuffer(b"".join(lists), np.int64).reshape(-1, 2)
                        cover = np.zeros(n + 1, np.int64)
                        np.add.at(cover, pairs[:, 0], 1)
                        np.add.at(cover, pairs[:, 0] + pairs[:, 1] + kind.width - 1, -1)
                        gone = np.cumsum(cover[:-1]) > 0
                    kept = kind.join(text, gone)
                    out["n"].append(n)
                    out["gone"].append(int(gone.sum()))
                    out["spans"].append(int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if n else 0)))
                    out["sha"].append(hashlib.sha256(kept).hexdigest())
                    out["text"].append(kept)
                columns = [part.column(0), pa.array(out["n"], pa.int64()), pa.array(out["gone"], pa.int64()), pa.array(out["spans"], pa.int64()), pa.array(out["sha"], pa.string())]
                names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"]
                if text_column:
                    columns.append(pa.array(out["text"], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, kind: Units, least, name: str, *, kept: bool, big: int = BIG, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 and, if asked for, kept (UTF-8) of every document."""
    spark, docs = docs.sparkSession, long_doc(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("hash", F.xxhash64("text"))
    volume = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (1 if kind.dtype == "u1" else 6)
    anchor_groups, groups = partitions(spark, volume / 16, GROUP_ANCHORS), partitions(spark, volume, GROUP_UNITS)

    # One document for each text; texts are told apart by 96 bits and their length.
    same = ("hash", "_h2", "_n")
    slim = cut(docs.select("doc_id", "hash", F.hash("text").alias("_h2"), F.octet_length("text").alias("_n")), f"{name}-texts")
    reps = slim.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    copies = slim.join(reps, list(same)).where("doc_id > rep").select("doc_id", "hash", F.lit(True).alias("copy")).distinct()

    packed = docs.select("hash", "text").mapInArrow(_anchors(kind, anchor_groups), _ANCHORS)
    shared = cut(packed.repartitionById(anchor_groups, "g").sortWithinPartitions("kind", "g").mapInArrow(_shared_anchors(big), "hash long, keys binary"), f"{name}-anchors")
    common = [np.frombuffer(r["keys"], np.uint64) for r in shared.where("hash is null").collect()]  # bounded, see BIG
    common = spark.sparkContext.broadcast(np.concatenate(common) if common else np.zeros(0, np.uint64))
    wanted = shared.where("hash is not null").groupBy("hash").agg(F.collect_list("keys").alias("keys"))  # no more of them than the text has windows
    wanted = wanted.join(reps, "hash").select(F.col("rep").alias("doc_id"), "hash", "keys")
    n = partitions(spark, volume, 64 << 20)
    dealt = docs.repartition(n, "doc_id")
    left = dealt.join(wanted, ["doc_id", "hash"]).select("doc_id", "text", "keys", "hash").mapInArrow(_segments(kind, groups, anchor_groups, common), _SEGMENTS)
    found = []
    for finer in (*levels(kind.width), None):
        step = left.repartitionById(groups, "g").sortWithinPartitions("kind", "g").mapInArrow(_found(kind, least, groups, finer, limit), _FOUND)
        step = cut(step, f"{name}-found")
        found.append(step.where("runs is not null").select("doc_id", "hash", "runs"))
        left = step.where("kind is not null").select(*_NAMES)
        if left.isEmpty():
            break
    gone = reduce(DataFrame.unionAll, found).groupBy("doc_id", "hash").agg(F.collect_list("runs").alias("runs"))
    last = ", kept binary" if kept else ""
    final = dealt.join(gone, ["doc_id", "hash"], "left").join(copies, ["doc_id", "hash"], "left").select("doc_id", "text", "runs", "copy")
    return final.mapInArrow(_cleaned(kind, kept), f"doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string{last}")
