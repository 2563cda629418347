"""One-to-one assignment within each key: optimal (two paddings) and greedy.

Keys spread over the cluster; those of tables are solved on their candidates alone (``sparse``). ``solve`` and what builds on it take one
small cost matrix, as its definition has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.jobs import written
from .sparse import heaviest

FORBIDDEN, DUMMY = 1e6, 0.999  # Fixed values of the padded cost matrix.


def solve(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest full assignment of a square matrix."""
    n = len(cost)
    u, v, owner, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[at] = True
            reduced = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], at
            nxt = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
            if not owner[at]:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = np.zeros(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def padded(score: np.ndarray, gate: np.ndarray) -> list[tuple[int, int]]:
    """As many gated pairs as there can be, and of such choices the cheapest by 1 - score."""
    r, g = score.shape
    cost = np.full((max(r, g),) * 2, DUMMY)
    cost[:r, :g] = np.where(gate, 1 - score, FORBIDDEN)
    return [(i, j) for i, j in enumerate(solve(cost)) if i < r and j < g and gate[i, j]]


def dummies(score: np.ndarray, gate: float) -> list[tuple[int, int]]:
    """Each item may stay alone at cost 1 - gate; pairs that score no more than the gate are dropped afterwards."""
    r, g = score.shape
    cost = np.full((r + g, r + g), 1 - gate)
    cost[:r, :g] = 1 - score
    cost[r:, g:] = 0
    return [(i, j) for i, j in enumerate(solve(cost)) if i < r and j < g and score[i, j] > gate]


def greedy(score: np.ndarray, gate: float) -> list[tuple[int, int]]:
    """Again and again the best pair above the gate of items still free; of equal ones the first by row, then column."""
    left, out = np.where(score > gate, score, -np.inf), []
    while left.size and np.isfinite(left).any():
        i, j = np.unravel_index(int(np.argmax(left)), left.shape)
        out.append((int(i), int(j)))
        left[i, :], left[:, j] = -np.inf, -np.inf
    return sorted(out)


def _edges(ref: np.ndarray, gen: np.ndarray, score: np.ndarray, gated: np.ndarray, mode: str) -> tuple[np.ndarray, ...]:
    """(refs, gens, i, j, score) of a key's candidates, each pair once with its best score; only gated ones but for ``dummy``."""
    refs, i = np.unique(ref, return_inverse=True)
    gens, j = np.unique(gen, return_inverse=True)
    order = np.lexsort((-score, j, i))
    i, j, score, gated = i[order], j[order], score[order], gated[order]
    first = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    open_ = np.logical_or.reduceat(gated, np.flatnonzero(first)) | (mode == "dummy")
    return refs, gens, i[first][open_], j[first][open_], score[first][open_]


def _weights(score: np.ndarray, mode: str, gate: float, sides: int) -> np.ndarray:
    """What a pair adds: of padded matrices first that it is one, then its score; of those with dummies what it costs less than its ends alone.

    Two items that stay alone cost 2 (1 - gate) with dummies, or 1 as a pair of score 0, whichever is less.
    """
    if mode == "event":
        return score + 2 + 2 * sides * max(1.0, float(np.abs(score).max(initial=0)))
    return score - 1 + min(1.0, 2 * (1 - gate))


def _chosen(ref: np.ndarray, gen: np.ndarray, score: np.ndarray, gated: np.ndarray, mode: str, gate: float) -> list[tuple[int, int, float]]:
    refs, gens, i, j, score = _edges(ref, gen, score, gated, mode)
    if mode == "greedy":
        taken = _greedily(i, j, score, gate)
    else:
        taken = heaviest(i, j, _weights(score, mode, gate, min(len(refs), len(gens))))[0]
        taken &= (score > gate) | (mode == "event")
    found = np.flatnonzero(taken)
    found = found[np.lexsort((gens[j[found]], refs[i[found]], -score[found]))]
    return list(zip(refs[i[found]].tolist(), gens[j[found]].tolist(), score[found].tolist(), strict=True))


def _greedily(i: np.ndarray, j: np.ndarray, score: np.ndarray, gate: float) -> np.ndarray:
    taken, rows, cols = np.zeros(len(i), bool), set(), set()
    for k in np.lexsort((j, i, -score)).tolist():
        if score[k] > gate and i[k] not in rows and j[k] not in cols:
            taken[k] = True
            rows.add(i[k])
            cols.add(j[k])
    return taken


def _by_key(it: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """For each batch the columns of the keys that end in it; a long key is put together once, when it ends."""
    held: list[list[np.ndarray]] = []

    def whole() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in it:
        if not len(batch):
            continue
        columns = [np.asarray(c) for c in batch.columns]
        edge = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1], True])
        done = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            part = [c[a:b] for c in columns]
            if held and held[0][0][0] != part[0][0]:
                done.append(whole())
                held.clear()
            held.append(part)
        if done:
            yield done
    if held:
        yield [whole()]


def _clean(pairs: DataFrame, key: str) -> DataFrame:
    clean = pairs.selectExpr(f"cast({key} as long) as key", "cast(ref_id as long) as ref_id", "cast(gen_id as long) as gen_id", "cast(score as double) as score", "coalesce(gated, false) as gated").dropna()
    return clean.repartition("key").sortWithinPartitions("key")


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))


def match(pairs: DataFrame, *, key: str = "key", mode: str = "event", gate: float = 0.0) -> DataFrame:
    """(key, ref_id, gen_id, score) chosen from candidate pairs (key, ref_id, gen_id, score, gated).

    ``mode`` is ``event`` (as many gated pairs as there can be, of such choices the best), ``dummy`` (items may stay alone) or ``greedy``.
    Pairs that are not among the candidates score 0 and are not gated. Null ids and scores take no part; a repeated pair counts by
    its best score. Keys are dealt by hash and sorted; a task holds the candidates of one key at a time, and solves the parts of it that no candidate
    joins apart. Rows of a key come out by score, then ids.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _by_key(it):
            rows = [(int(c[0][0]), *r) for c in keys for r in _chosen(*c[1:], mode, gate)]
            yield _batch(rows, ("key", "ref_id", "gen_id", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))

    return _clean(pairs, key).mapInArrow(run, "key long, ref_id long, gen_id long, score double")


def prices(pairs: DataFrame, *, key: str = "key", mode: str = "event", gate: float = 0.0) -> DataFrame:
    """(key, side, id, price, weight): the proof that ``match`` is optimal, for ``event`` and ``dummy``.

    A row for each item of a key's candidates: side 0 for references, 1 for generated items. No price is negative, the prices of both ends of a
    candidate that may be chosen are at least what it adds, and all prices of a key add up to what the chosen pairs add, as no choice could have
    more. ``weight`` is what the pair of a reference adds that has been chosen, null of all others.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _by_key(it):
            rows = []
            for c in keys:
                refs, gens, i, j, score = _edges(*c[1:], mode)
                w = _weights(score, mode, gate, min(len(refs), len(gens)))
                taken, u, v = heaviest(i, j, w)
                have = dict(zip(i[taken].tolist(), w[taken].tolist(), strict=True))
                u, v = np.r_[u, np.zeros(len(refs) - len(u))], np.r_[v, np.zeros(len(gens) - len(v))]
                rows += [(int(c[0][0]), 0, r, p, have.get(k)) for k, (r, p) in enumerate(zip(refs.tolist(), u.tolist(), strict=True))]
                rows += [(int(c[0][0]), 1, g, p, None) for g, p in zip(gens.tolist(), v.tolist(), strict=True)]
            yield _batch(rows, ("key", "side", "id", "price", "weight"), (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))

    return _clean(pairs, key).mapInArrow(run, "key long, side int, id long, price double, weight double")


def certificate(pairs: DataFrame, *, key: str = "key", mode: str = "event", gate: float = 0.0) -> DataFrame:
    """(key, n, one_to_one, feasible, gap) by joins of ``match`` and ``prices`` with the candidates: pairs chosen, whether none shares an end, whether
    prices cover every candidate that may be chosen, and the total of the prices less that of the choice, 0 of an optimal one."""
    pairs = written(pairs.select(key, "ref_id", "gen_id", "score", "gated"), "assign-candidates")
    found, price = match(pairs, key=key, mode=mode, gate=gate), written(prices(pairs, key=key, mode=mode, gate=gate), "assign-prices")
    side = lambda n, c: price.where(F.col("side") == n).select("key", F.col("id").alias(f"{c}_id"), F.col("price").alias(f"{c}_price"))
    able = _clean(pairs, key).groupBy("key", "ref_id", "gen_id").agg(F.max("score").alias("score"), F.bool_or("gated").alias("gated"))
    if mode == "event":
        least = F.least(F.count_distinct("ref_id"), F.count_distinct("gen_id"))
        sides = able.groupBy("key").agg(least.alias("sides"))
        able = able.where("gated").join(sides, "key")
        top = F.greatest(F.lit(1.0), F.max(F.abs("score")).over(Window.partitionBy("key")))
        able = able.withColumn("w", F.col("score") + 2 + 2 * F.col("sides") * top)
    else:
        able = able.withColumn("w", F.col("score") - 1 + min(1.0, 2 * (1 - gate)))
    covered = able.join(side(0, "ref"), ["key", "ref_id"]).join(side(1, "gen"), ["key", "gen_id"]).groupBy("key").agg(F.min(F.col("ref_price") + F.col("gen_price") - F.col("w")).alias("slack"))
    total = price.groupBy("key").agg(F.sum("price").alias("bound"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"), F.min("price").alias("least"))
    ends = found.groupBy("key").agg(F.count("*").alias("n"), (F.count("*") == F.least(F.count_distinct("ref_id"), F.count_distinct("gen_id"))).alias("one_to_one"))
    out = total.join(covered, "key", "left").join(ends, "key", "left")
    feasible = (F.coalesce("slack", F.lit(0.0)) > -1e-6) & (F.col("least") >= 0)
    return out.select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("one_to_one", F.lit(True)).alias("one_to_one"), feasible.alias("feasible"), (F.col("bound") - F.col("total")).alias("gap"))
