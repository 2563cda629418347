"""Heaviest matching of a sparse bipartite graph, with the dual values that prove it.

Components of the graph are solved apart. Within one, rows first bid for their columns as in an auction, which settles most of them; those left over
take shortest augmenting paths over the edges that there are. Memory grows with the edges.
"""

from __future__ import annotations

import heapq

import numpy as np


def components(i: np.ndarray, j: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """The component of each edge, as the least row in it: labels sink along edges, and each label to that of its own row."""
    label = np.arange(rows)
    while True:
        low = np.full(cols, rows)
        np.minimum.at(low, j, label[i])
        new = label.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, label, new)  # whole groups move together
        new = new[new]
        if (new == label).all():
            return label[i]
        label = new


def _bids(adj: list[list[tuple[int, float]]], u: list[float], v: list[float], mate: list[int], owner: list[int]) -> list[int]:
    """Rows bid the margin of their best column over the next best choice, staying alone among them; the rows that are still without a column."""
    left, turns = [], 4 * len(adj)
    queue = list(range(len(adj) - 1, -1, -1))
    while queue:
        r = queue.pop()
        best, second, at = 0.0, 0.0, -1
        for j, w in adj[r]:
            gain = w - v[j]
            if gain > best:
                best, second, at = gain, best, j
            elif gain > second:
                second = gain
        if at < 0:
            u[r] = 0.0  # alone
            continue
        turns -= 1
        if owner[at] >= 0 and (turns < 0 or best <= second):
            u[r] = best
            left.append(r)
            continue
        if owner[at] >= 0:
            mate[owner[at]] = -1
            queue.append(owner[at])
            u[r], v[at] = second, v[at] + best - second
        else:
            u[r] = best
        owner[at], mate[r] = r, at
    return left


def _augment(r: int, adj, u, v, mate, owner) -> None:
    """The shortest path from a row without a column to a free column, or to a row that may stay alone instead."""
    dist, via, heap = {}, {}, []
    reached, done = [(r, 0.0)], []
    row, base, alone, last = r, 0.0, u[r], r
    while True:
        for j, w in adj[row]:
            d = base + max(0.0, u[row] + v[j] - w)
            if d < dist.get(j, alone):
                dist[j], via[j] = d, row
                heapq.heappush(heap, (d, j))
        while heap and heap[0][0] > dist[heap[0][1]]:
            heapq.heappop(heap)
        if not heap or heap[0][0] >= alone:
            end, stop = -1, alone
            break
        d, j = heapq.heappop(heap)
        if owner[j] < 0:
            end, stop = j, d
            break
        done.append((j, d))
        dist[j] = -1.0  # settled
        row, base = owner[j], d
        reached.append((row, base))
        if base + u[row] < alone:
            alone, last = base + u[row], row
    for x, d in reached:
        u[x] = max(0.0, u[x] - (stop - d)) if d < stop else u[x]
    for j, d in done:
        v[j] += max(0.0, stop - d)
    if end < 0:
        if last == r:
            return
        end = mate[last]
        mate[last] = -1
    while True:
        row = via[end]
        owner[end], mate[row], end = row, end, mate[row]
        if row == r:
            return


def heaviest(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which edges are taken, u of each row, v of each column) of the one-to-one choice of edges (i, j, w) of the largest total weight.

    No two edges have both ends in common. Edges of no or negative weight are never taken. u + v is at least w on every edge, none is negative, and
    their sum is the total of what is taken, which is the proof that there is no better choice.
    """
    rows, cols = int(i.max(initial=-1)) + 1, int(j.max(initial=-1)) + 1
    u, v, taken = np.zeros(rows), np.zeros(cols), np.zeros(len(i), bool)
    live = np.flatnonzero(w > 0)
    if not len(live):
        return taken, u, v
    part = components(i[live], j[live], rows, cols)
    order = live[np.lexsort((j[live], i[live], part))]
    part = np.sort(part)
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    single = order[edge[:-1][np.diff(edge) == 1]]
    taken[single], u[i[single]] = True, w[single]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a == 1:
            continue
        own = order[a:b]
        names, at = np.unique(i[own], return_inverse=True)
        goods, to = np.unique(j[own], return_inverse=True)
        adj: list[list[tuple[int, float]]] = [[] for _ in names]
        where = {}
        for k, (x, y, z) in enumerate(zip(at.tolist(), to.tolist(), w[own].tolist(), strict=True)):
            adj[x].append((y, z))
            where[x, y] = k
        du, dv, mate, owner = [0.0] * len(names), [0.0] * len(goods), [-1] * len(names), [-1] * len(goods)
        for r in _bids(adj, du, dv, mate, owner):
            _augment(r, adj, du, dv, mate, owner)
        u[names], v[goods] = du, dv
        taken[own[[where[x, y] for x, y in enumerate(mate) if y >= 0]]] = True
    return taken, u, v
