"""Substring dedup over bytes by merging Burrows-Wheeler transforms of shards.

Each shard of distinct segments has its own transform. They are merged by refining an interleave: at first the shards' rows stand one
after another; reading the merged transform and dealing its symbols into buckets, stably, gives the interleave that is right for one
symbol more. Blocks of rows that agree so far are split on the way, so that each border's round gives the common prefix of
two neighbours; after ``width`` rounds the blocks are the repeated intervals. No suffix is sorted again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import BIG, LIMIT, Units, remove_repeats

#: Bytes of one shard's segments, with their ends; places must fit in 21 bits.
SHARD = 1 << 19


def byte_units(width: int) -> Units:
    return Units(read=lambda data, ends: (data, ends), join=lambda text, gone: np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text, dtype="u1", width=width, gram=max(1, min(20, width)))


def transform(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, place of each row, bytes with ends) of a shard: symbols are byte + 1, and 0 ends a segment. Ends sort first, by segment."""
    lens = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(lens + 1) - 1
    n = int(ends[-1]) + 1
    text = np.zeros(n, np.uint16)
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = np.concatenate(segments).astype(np.uint16) + 1
    left = np.repeat(ends, lens + 1) - np.arange(n)  # symbols up to the end
    place, h = np.arange(n, dtype=np.uint64), 4
    key = np.zeros(n, np.uint64)
    padded = np.r_[text, np.zeros(4, np.uint16)]
    for k in range(4):
        key = (key << np.uint64(9)) | np.where(left >= k, padded[k : k + n], 0).astype(np.uint64)
    while True:
        key = np.sort((key << np.uint64(21)) | place)
        order = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        key >>= np.uint64(21)
        # A suffix that has ended within h symbols is like no other.
        fresh = np.r_[True, (key[1:] != key[:-1]) | (left[order[1:]] < h)]
        if fresh.all():
            return np.where(order > 0, text[order - 1], 0).astype(np.uint16), order, text
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        after[: n - h] = rank[h:]
        after[left < h] = 0
        key = (rank << np.uint64(21)) | after
        h *= 2


def _deal(out: np.ndarray, shard: np.ndarray, parts: list[np.ndarray]) -> None:
    """Put each shard's values, in order, at the rows that are its own; many shards in one sort instead of a pass for each."""
    if len(parts) <= 8:
        for z, part in enumerate(parts):
            out[shard == z] = part
    else:
        out[np.argsort(shard, kind="stable")] = np.concatenate(parts)


def interleave(transforms: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each merged row, common prefix with the row before as far as ``depth``) of the shards' transforms.

    ``ends`` are the numbers of segments. The common prefix of a row is the round in which it is told apart from the row before, less one.
    """
    n, total = sum(map(len, transforms)), sum(ends)
    kind = np.uint8 if max(int(t.max(initial=0)) for t in transforms) < 256 else np.uint16
    transforms = [t.astype(kind) for t in transforms]
    number = np.min_scalar_type(len(transforms))  # as wide as the shards are many
    shard = np.repeat(np.arange(len(transforms), dtype=number), [len(t) for t in transforms])
    head = np.repeat(np.arange(len(ends), dtype=number), ends)
    block = np.zeros(n, np.int32)
    common = np.full(n, depth, np.int32)
    common[:1] = 0
    symbols = np.empty(n, kind)
    for h in range(1, depth + 1):
        _deal(symbols, shard, transforms)
        order = np.argsort(symbols, kind="stable")
        read, was = symbols[order], block[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (read[1:] != read[:-1]) | (was[1:] != was[:-1])
        new[: total + 1] = True  # ends differ from each other, and the first symbol after them
        common[new & (common == depth)] = h - 1
        nxt = shard[order]
        nxt[:total] = head
        block = np.cumsum(new, dtype=np.int32)
        if block[-1] == n:
            return nxt, common
        shard = nxt
    return shard, common


def least_documents(segments: list[np.ndarray], smallest: np.ndarray, width: int) -> np.ndarray:
    """For the windows of distinct segments one after another, the smallest document that has each."""
    size = np.array([len(s) for s in segments], np.int64)
    per = size - width + 1
    base = np.cumsum(per) - per
    out = np.repeat(smallest, per)
    shards, at, n = [], 0, 0
    for k, m in enumerate((size + 1).tolist()):
        if n and n + m > SHARD:
            shards.append((at, k))
            at, n = k, 0
        n += m
    shards.append((at, len(segments)))
    transforms, places, row_base = [], [], 0
    window = []
    for a, b in shards:
        t, order, _ = transform(segments[a:b])
        transforms.append(t)
        # The window that each row's place is, or -1 for the places less than a window before an end.
        number = np.full(len(t), -1, np.int64)
        first = np.cumsum(size[a:b] + 1) - size[a:b] - 1
        spots = np.repeat(first - (base[a:b] - base[a]), per[a:b]) + np.arange(int(per[a:b].sum()))
        number[spots] = np.arange(len(spots)) + base[a]
        window.append(number[order])
    shard, common = interleave(transforms, [b - a for a, b in shards], width)
    merged = np.empty(len(shard), np.int64)
    _deal(merged, shard, window)
    block = np.flatnonzero(common < width)
    n_rows = np.diff(np.r_[block, len(merged)])
    value = np.where(merged >= 0, out[np.maximum(merged, 0)], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(value, block), n_rows)
    live = merged >= 0
    out[merged[live]] = least[live]
    return out


def remove_repeated_bytes(docs: DataFrame, *, width: int = 50, kept: bool = True, big: int = BIG, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_units (bytes of UTF-8), n_removed, n_spans (maximal removed runs), kept_sha256 and, unless ``kept`` is false, kept: the bytes that remain.

    A byte goes if it is covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id. Strings are judged on the
    input and never cross documents; what is kept may not be UTF-8. Null and empty texts have no bytes. Rows without an id are left out;
    rows that repeat an id are one document to the rule and give a row each. Other columns are not looked at. ``big`` and ``limit`` are explained in ``repeats``.
    """
    return remove_repeats(docs, byte_units(width), least_documents, "bwt-merge", kept=kept, big=big, limit=limit)
