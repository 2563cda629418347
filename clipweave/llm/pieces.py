"""SentencePiece encoding and decoding with N-best segmentation.

Forward Viterbi scores of the piece lattice are exact heuristics for a backward A* search: a partial path from the end back to
a place is worth its own score and the best score up to that place, so complete paths come out best first. A text is cut
into units that no piece crosses (a run of spaces with the word after it; a run of line ends), the lattice falls apart
there, and equal units are searched once. The N best of a text differ from its best one only in the N - 1
units whose second best loses least, so only these are searched beyond their second best.

A model with merge ranks for scores (BPE) says nothing of likelihood; its pieces then get the log-probabilities that Zipf's law gives their ranks. So
segmentations are the likeliest ones under that law, and not the merges' own: most words agree with the library's BPE ids, whole texts seldom do.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .shared import long_doc, slices

SPACE = "▁"
#: Loss, below the least piece score, of a character without a piece; it is then spelled in bytes.
UNKNOWN_LOSS = 10.0
#: Units whose results a task keeps.
CACHE_UNITS = 250_000
#: New units whose lattices are laid out at a time, and text that is cut into units at a time.
LEARN_UNITS, TEXT_BYTES = 8_000, 512 << 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")


def _log_probabilities(score: dict[int, float]) -> dict[int, float]:
    """Scores in steps of 2**-20, so that their sums are exact and equal ones tie.

    Where all are different whole numbers below 0 they are merge ranks, and become log(1 / (rank + 2.7)), normalised. Pieces that a model
    keeps out by a score of -1e8 or less (runs of spaces) lose ``UNKNOWN_LOSS`` against the least of the others.
    """
    live = {i: s for i, s in score.items() if s > -1e8}
    if len(set(live.values())) == len(live) and all(s < 0 and s == int(s) for s in live.values()):
        total = math.log(sum(1 / (2.7 - s) for s in live.values()))
        live = {i: -math.log(2.7 - s) - total for i, s in live.items()}
    least = min(live.values()) - UNKNOWN_LOSS
    return {i: round(live.get(i, least) * (1 << 20)) / (1 << 20) for i in score}


class Lattice:
    """A piece vocabulary with its search. ``path`` names a model whose pieces have scores."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = _log_probabilities({i: float(sp.get_score(i)) for i in plain})
        self.ids = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.ids))
        crossing = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross units: {crossing[:3]}")
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        spelled = {i: bytes([b]) for b, i in self.byte.items()}
        spelled |= {i: self.text[i].replace(SPACE, " ").encode() for i in plain}
        parts = [spelled.get(i, b"") for i in range(n)]
        self.raw, self.raw_ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        self.floor = min(self.score.values()) - UNKNOWN_LOSS
        self.tails: dict[str, int] = {}
        for p in self.ids:
            self.tails[p[-2:]] = max(self.tails.get(p[-2:], 0), len(p))
        self._trie()
        self._forget()

    def edges(self, unit: str, b: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The edges (start, score, ids) that arrive at the place ``b``, shortest first."""
        ids, score = self.ids, self.score
        last = unit[b - 1]
        out = [(b - 1, score[ids[last]], (ids[last],)) if last in ids else (b - 1, self.floor, tuple(self.byte[x] for x in last.encode()))]
        for a in range(b - 2, max(-1, b - 1 - self.tails.get(unit[max(0, b - 2) : b], 0)), -1):
            if (i := ids.get(unit[a:b])) is not None:
                out.append((a, score[i], (i,)))
        return out

    def forward(self, unit: str) -> list[float]:
        best = [0.0] * (len(unit) + 1)
        for b in range(1, len(best)):
            best[b] = max(best[a] + s for a, s, _ in self.edges(unit, b))
        return best

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations, best first; of equal scores the one first whose pieces are longer, from the end.

        A path holds its last piece and the path behind it, and edges are found when they are needed, so that memory grows with the
        unit's length. Of paths of one worth the newest goes on: they are walked one after another, not side by side.
        """
        best, found = self.forward(unit), []
        heap, pushed = [(-best[-1], 0, len(unit), 0.0, None)], 0
        while heap and len(found) < n:
            _, _, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    part, path = path
                    ids += part
                found.append((done, tuple(ids)))
                continue
            for a, s, ids in self.edges(unit, at):
                pushed += 1
                heapq.heappush(heap, (-(best[a] + done + s), -pushed, a, done + s, (ids, path)))
        return found

    def two(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """(ids of the best segmentation, its score, what the second best loses)."""
        found = self.search(unit, 2)
        return found[0][1], found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf

    def _add(self, ids: np.ndarray, lens: np.ndarray, score: np.ndarray, loss: np.ndarray, units: list[str]) -> None:
        at = len(self.known)
        self.known.update(zip(units, range(at, at + len(units)), strict=True))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
        self.scores, self.losses = np.concatenate([self.scores, score]), np.concatenate([self.losses, loss])
        self.names += units

    def _forget(self) -> None:
        """What is known of units: place, ids (flat, with ends), best score, loss of the second best."""
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.scores, self.losses = np.zeros(0), np.zeros(0)
        self.searched: dict[tuple[int, int], list] = {}

    def learn(self, units: list[str]) -> None:
        """Viterbi from both ends over many new units at once. The second best of a unit goes through the best edge outside its best path."""
        plain = [u for u in units if len(u) <= 48 and self.chars.issuperset(u)]
        for u in set(units).difference(plain):
            ids, score, loss = self.two(u)
            self._add(np.array(ids), np.array([len(ids)]), np.array([score]), np.array([loss]), [u])
        for at in range(0, len(plain), LEARN_UNITS):
            self._learn(plain[at : at + LEARN_UNITS])

    def _learn(self, units: list[str]) -> None:
        n = np.array([len(u) for u in units])
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        end = np.cumsum(n)
        stop = np.repeat(end, n)
        # Edges: from every place, as long as what is read begins some piece.
        at = np.arange(len(code))
        node = np.zeros(len(code), np.int64)
        reach, pieces = [], []
        start = at
        while len(at):
            node = self._step(node, code[at])
            live = node >= 0
            at, node, start = at[live] + 1, node[live], start[live]
            hit = self.node_id[node] >= 0
            reach.append((start[hit], at[hit]))
            pieces.append(self.node_id[node[hit]])
            live = at < stop[start]
            at, node, start = at[live], node[live], start[live]
        a, b = (np.concatenate(x) for x in zip(*reach, strict=True))
        piece = np.concatenate(pieces)
        s = self.score_of[piece]
        unit = np.repeat(np.arange(len(units)), n)[a]
        first = end - n
        a, b = a + unit, b + unit  # n + 1 places a unit
        zero, last = first + np.arange(len(units)), end + np.arange(len(units))
        best, back = np.full(len(code) + len(units), -np.inf), np.full(len(code) + len(units), -np.inf)
        best[zero], back[last] = 0.0, 0.0
        via = np.zeros(len(best), np.int64)
        depth = b - zero[unit]
        order = np.lexsort((a, b, depth))
        for run in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            value = best[a[run]] + s[run]
            heads = np.flatnonzero(np.r_[True, b[run][1:] != b[run][:-1]])
            top = np.maximum.reduceat(value, heads)
            best[b[run][heads]] = top
            is_top = np.flatnonzero(value == np.repeat(top, np.diff(np.r_[heads, len(run)])))[::-1]
            via[b[run][is_top]] = run[is_top]  # of equal ones the longest piece, written last
        left = last[unit] - a
        order = np.lexsort((b, a, left))
        for run in np.split(order, np.flatnonzero(np.diff(left[order])) + 1):
            value = back[b[run]] + s[run]
            heads = np.flatnonzero(np.r_[True, a[run][1:] != a[run][:-1]])
            back[a[run][heads]] = np.maximum.reduceat(value, heads)
        on, now, who, taken, owner = np.zeros(len(a), bool), last.copy(), np.arange(len(units)), [], []
        while len(who):
            e = via[now]
            on[e] = True
            taken.append(e)
            owner.append(who)
            now = a[e]
            more = now > zero[who]
            now, who = now[more], who[more]
        taken, owner = np.concatenate(taken)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        taken = taken[order]
        second = np.full(len(units), -np.inf)
        off = ~on
        np.maximum.at(second, unit[off], (best[a] + s + back[b])[off])
        self._add(piece[taken], np.bincount(owner, minlength=len(units)), best[last], best[last] - second, units)

    def _trie(self) -> None:
        """Nodes of all beginnings of pieces, and a hash table from (node, character) to node."""
        nodes: dict[str, int] = {"": 0}
        for p in self.ids:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.node_id = np.full(len(nodes), -1, np.int64)
        for p, i in self.ids.items():
            self.node_id[nodes[p]] = i
        self.score_of = np.zeros(len(self.text))
        for i, x in self.score.items():
            self.score_of[i] = x
        key = np.array([(nodes[p[:-1]] << 21) | ord(p[-1]) for p in nodes if p], np.uint64)
        to = np.array([v for p, v in nodes.items() if p], np.int64)
        bits = 20
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_to = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, -1, np.int64)
        for k, v, at in zip(key, to, ((key * _ODD) >> self.shift).astype(np.int64).tolist(), strict=True):
            while self.slot_to[at] >= 0:
                at = (at + 1) & self.mask
            self.slot_key[at], self.slot_to[at] = k, v
        self.chars = {p for p in self.ids if len(p) == 1}

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = (node.astype(np.uint64) << np.uint64(21)) | code
        slot = ((key * _ODD) >> self.shift).astype(np.int64)
        out = np.where(self.slot_key[slot] == key, self.slot_to[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_to[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            here = self.slot_key[slot[open_]] == key[open_]
            out[open_[here]] = self.slot_to[slot[open_[here]]]
            open_ = open_[~here & (self.slot_to[slot[open_]] >= 0)]
        return out

    def split(self, text: str) -> list[str]:
        """Units of a text, with spaces as pieces write them; a text that is not empty gets one space in front."""
        return _UNIT.findall((" " + text).replace(" ", SPACE)) if text else []

    def nbest(self, text: str, n: int) -> tuple[list[np.ndarray], list[float]]:
        """Ids and score of the ``n`` best segmentations of a whole text (all, if fewer), best first."""
        return self.nbest_of([text], n)[0]

    def nbest_of(self, texts: list[str], n: int) -> list[tuple[list[np.ndarray], list[float]]]:
        if len(self.known) > CACHE_UNITS:
            self._forget()
        units = [self.split(t) for t in texts]
        if new := {u for us in units for u in us}.difference(self.known):
            self.learn(sorted(new))
        return [self._best(np.fromiter(map(self.known.__getitem__, us), np.int64, len(us)), n) for us in units]

    def _ids(self, places: np.ndarray) -> np.ndarray:
        first, lens = self.ends[places], self.ends[places + 1] - self.ends[places]
        return self.flat[np.repeat(first - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))]

    def _best(self, places: np.ndarray, n: int) -> tuple[list[np.ndarray], list[float]]:
        base = float(self.scores[places].sum())
        loss = self.losses[places]
        loose = np.flatnonzero(loss < np.inf)
        if n < 2 or not len(loose):
            return [self._ids(places)], [base]
        if len(loose) >= n:
            loose = loose[loss[loose] <= np.partition(loss[loose], n - 2)[n - 2]]
        loose = np.sort(loose[np.argsort(loss[loose], kind="stable")[: n - 1]]).tolist()
        # Combinations of the loose units' own N best, from the best down.
        options = []
        for k in loose:
            u = int(places[k])
            if (u, n) not in self.searched:
                self.searched[u, n] = [(s, np.array(ids, np.int32)) for s, ids in self.search(self.names[u], n)]
            options.append(self.searched[u, n])
        zero = (0,) * len(loose)
        heap, seen, out = [(0.0, zero)], {zero}, []
        while heap and len(out) < n:
            lost, pick = heapq.heappop(heap)
            out.append((lost, pick))
            for j in range(len(pick)):
                nxt = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                if nxt[j] < len(options[j]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (sum(o[0][0] - o[x][0] for o, x in zip(options, nxt, strict=True)), nxt))
        between = [self._ids(places[a:b]) for a, b in zip([0, *(k + 1 for k in loose)], [*loose, len(places)], strict=True)]
        results = []
        for _, pick in out:
            parts = [between[0]]
            for j, x in enumerate(pick):
                parts += [options[j][x][1], between[j + 1]]
            results.append(np.concatenate(parts))
        return results, [base - lost for lost, _ in out]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of a segmentation, without the space that encoding put in front."""
        if not len(ids):
            return b""
        lens = self.raw_ends[ids + 1] - self.raw_ends[ids]
        return self.raw[np.repeat(self.raw_ends[ids] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))].tobytes()[1:]

    def decode(self, ids) -> str:
        """The text of a segmentation; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_LOADED: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The worker's own copy; it stays for the tasks that follow, without what was learned of units."""
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


def _encode(path: str, n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        try:
            for batch in it:
                for part in slices(batch, 1, TEXT_BYTES):
                    ids, scores, sums, same = [], [], [], []
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for text, (best, worth) in zip(texts, model.nbest_of(texts, n), strict=True):
                        ids.append(best[0])
                        scores.append(worth)
                        sums.append([zlib.crc32(x.astype("<u4").tobytes()) for x in best])
                        same.append(model.decode_bytes(best[0]) == text.replace(SPACE, " ").encode())
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists, pa.array(scores, pa.list_(pa.float64())), pa.array(sums, pa.list_(pa.int64())), pa.array(same, pa.bool_())], names=["doc_id", "ids", "scores", "ids_crc32", "round_trip"])
        finally:
            model._forget()  # a worker that waits, or does another step, does not hold this one's units

    return run


def encode(docs: DataFrame, path: str, *, nbest: int = 4) -> DataFrame:
    """A row per document: doc_id, ids of its best segmentation, scores and crc32 of the ids of its ``nbest`` (of as many as there are), round_trip.

    Ids are of the whole text; a null or empty one has none, with score 0. Of segmentations with equal scores, those are given that the search
    meets first, the same ones each time. ``round_trip`` tells that decoding gives the text back, where U+2581 counts as a space.
    Rows without an id are left out, repeated rows give a row each, and other columns are not looked at. Needs no shuffle.
    """
    return long_doc(docs).mapInArrow(_encode(path, nbest), "doc_id long, ids array<int>, scores array<double>, ids_crc32 array<long>, round_trip boolean")


def _decode(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
