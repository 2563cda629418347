"""Substring dedup over words with prefix-partitioned suffix trees.

The suffixes that start at repeated windows' places are split by variable-length prefixes - one word, two, four, ... where a group
is still too large for memory - and each group's subtree is built by itself: suffixes in order and the common prefixes of
neighbours, whose intervals of depth ``width`` or more are the subtree's deep internal nodes. A node's leaves are all places of one
repeat; the smallest document among them keeps it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import BIG, LIMIT, Units, remove_repeats
from .shared import word_hashes

#: Suffixes of one subtree.
SUBTREE = 1 << 18


def _join(text: bytes, gone: np.ndarray) -> bytes:
    words = text.split()
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)


def word_units(width: int) -> Units:
    return Units(read=lambda data, ends: word_hashes(data, ends)[:2], join=_join, dtype="u8", width=width, gram=max(1, min(8, width)))


class Names:
    """Ranks of the substrings of lengths 1, 2, 4, ... that start at each place: equal for equal ones, ordered as they are."""

    def __init__(self, text: np.ndarray, longest: int):
        self.by_length = {1: np.unique(text, return_inverse=True)[1].astype(np.int64)}
        h = 1
        while 2 * h <= longest:
            cur = self.by_length[h]
            nxt = np.zeros(len(cur), np.int64)
            nxt[: len(cur) - h] = cur[h:] + 1
            self.by_length[2 * h] = np.unique(cur * (int(cur.max(initial=0)) + 2) + nxt, return_inverse=True)[1].astype(np.int64)
            h *= 2

    def rank(self, at: np.ndarray, length: int) -> list[np.ndarray]:
        """Ranks of the pieces, longest first, that make up the substrings of ``length`` words at the places ``at``."""
        out, done = [], 0
        for h in sorted(self.by_length, reverse=True):
            while length - done >= h:
                out.append(self.by_length[h][at + done])
                done += h
        return out


def prefix_groups(at: np.ndarray, names: Names, limit: int) -> list[np.ndarray]:
    """Places in groups of at most ``limit``: whole groups of one prefix, several beside each other, each prefix as short as does; only a group of one longest prefix may be larger."""
    done, queue = [], [(at, 1)]
    while queue:
        places, length = queue.pop()
        rank = names.by_length[length][places]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        start = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        sizes = np.diff(np.r_[start, len(places)])
        held, n = [], 0
        for a, m in zip(start.tolist(), sizes.tolist(), strict=True):
            group = places[a : a + m]
            if m > limit and 2 * length in names.by_length:
                queue.append((group, 2 * length))
                continue
            if held and n + m > limit:
                done.append(np.concatenate(held))
                held, n = [], 0
            held.append(group)
            n += m
        if held:
            done.append(np.concatenate(held))
    return done


def subtree(at: np.ndarray, names: Names, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, common prefix of each with the one before), both as far as ``depth``."""
    pieces = names.rank(at, depth)
    order = np.lexsort(pieces[::-1])
    at = at[order]
    common, behind = np.zeros(len(at), np.int64), np.arange(1, len(at))
    for h in sorted(names.by_length, reverse=True):
        some = behind[common[behind] + h <= depth]
        same = some[names.by_length[h][at[some] + common[some]] == names.by_length[h][at[some - 1] + common[some]]]
        common[same] += h
    return at, common


def least_documents(segments: list[np.ndarray], smallest: np.ndarray, width: int) -> np.ndarray:
    """For the windows of distinct segments one after another, the smallest document that has each."""
    per = np.array([len(s) - width + 1 for s in segments], np.int64)
    text = np.concatenate(segments)
    size = per + width - 1
    first = np.cumsum(size) - size
    base = np.cumsum(per) - per
    at = np.repeat(first - base, per) + np.arange(int(per.sum()))
    number = np.full(len(text), -1, np.int64)
    number[at] = np.arange(len(at))
    out = np.repeat(smallest, per)
    names = Names(text, width)
    for group in prefix_groups(at, names, SUBTREE):
        places, common = subtree(group, names, width)
        leaves = number[places]
        node = np.flatnonzero(np.r_[True, common[1:] < width])
        n = np.diff(np.r_[node, len(places)])
        out[leaves] = np.repeat(np.minimum.reduceat(out[leaves], node), n)
    return out


def remove_repeated_words(docs: DataFrame, *, width: int = 50, kept: bool = True, big: int = BIG, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept_sha256 and, unless ``kept`` is false, kept: the text without its repeats, words joined by one space.

    A word goes if it is covered by a window of ``width`` words whose sequence also starts in a document with a smaller doc_id; words are runs
    without space and \\x09-\\x0D. Windows are judged on the input. Null and empty texts have no words. Rows without an id are left out;
    rows that repeat an id are one document to the rule and give a row each. Other columns are not looked at. ``big`` and ``limit`` are explained in ``repeats``. Words are compared by 64-bit hashes.
    """
    return remove_repeats(docs, word_units(width), least_documents, "suffix-tree", kept=kept, big=big, limit=limit)
