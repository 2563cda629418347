"""N-gram Jaccard join by PartEnum signatures.

Sets are put into bands of size whose ends differ by the similarity at most, so that two sets similar enough lie in one band
or in neighbours. In the instance of the larger set's band the two differ in at most k elements. The domain is parted into
n1 parts by hash and each into three; of n1 = ceil((k + 1) / 2) parts at least one has at most one difference, so that
two of its three have none: the two sets share one of the 3 * n1 signatures (part, pair of thirds, their elements).
Signatures of no or one element select too little. With some parts more they are needless: leaving out a part takes two differences
where none of its signatures is that weak, one where some are, and none where all are. A set for which that is not enough
joins each weak signature with every one of a second, independent partition.
Sets that share a signature are compared exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import SLICE_BYTES, by_key, cut, long_doc, mix, partitions, raw, slices, window_hash, word_hashes

#: Signatures that one group of the candidate search holds in memory, on average.
GROUP_SIGNATURES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words, ASCII lower case; a shorter text is one shingle."""
    words, before, _ = word_hashes(*raw(texts), lower=True)
    runs, out = window_hash(words, width), []
    for at, end in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if end - at >= width:
            s = np.sort(runs[at : end - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[at:end].tobytes(), seed=end - at)] if end > at else [], np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(63 bits, 64 bits) of each set; equal sets have equal ones. Candidates go by the first, sets are equal by both and their size."""
    one = [xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes()) >> 1 or 1 if len(s) else 0 for s in sets]
    two = [xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), seed=1) if len(s) else 0 for s in sets]
    return np.array(one, np.int64), np.array(two, np.uint64).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """Bits, each the parity of the elements that hash to it: two sets differ in as many elements at least as these in bits.

    There are 1,024 bits, or as many as twice the elements at least, so that few differences of a long set fall on one bit. A half of
    the bits XOR the other is the parity of half the width.
    """
    wide = 1 << max(10, (2 * len(s) - 1).bit_length()) if len(s) else 1024
    odd = np.bincount((mix(s + _BASE) & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(column: pa.Array) -> np.ndarray:
    """Parities of different widths as rows of the least of them."""
    flat, sizes = np.asarray(column.flatten(), np.int64), np.asarray(column.value_lengths(), np.int64)
    starts, least = np.cumsum(sizes) - sizes, int(sizes.min(initial=1 << 40)) if len(sizes) else 16
    out = np.zeros((len(sizes), least), np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        bits = flat[starts[rows][:, None] + np.arange(size)]
        while bits.shape[1] > least:
            bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
        out[rows] = bits
    return out


def bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands, and k of each: how many elements two sets may differ in whose larger lies there."""
    first, k = [], []
    at = 1
    while at <= upto or len(first) < 2:
        last = at * 100 // percent
        first.append(at)
        k.append(2 * last * (100 - percent) // (100 + percent))
        at = last + 1
    return np.array(first, np.int64), np.array(k, np.int64)


#: A signature of so many elements or fewer is weak.
WEAK = 1
#: Members of a bucket above which those of one slice of texts stand behind one of theirs, and above which a bucket is dealt out again, then into blocks.
HEAVY, HOT = 64, 4096
#: Rounds in which sure pairs stand for others, after which all pairs that are left are compared.
ROUNDS = 2


def _spare(parts: np.ndarray) -> np.ndarray:
    """Parts beyond the least number, so that weak signatures are seldom needed."""
    return np.ceil(0.08 * parts + 0.5 * np.sqrt(parts)).astype(np.int64)


def _instance(sets: list[np.ndarray], owner: np.ndarray, band: np.ndarray, used: np.ndarray, k: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, elements behind it) of the sets of ``owner`` under the instance ``band``, of the first ``used`` parts; rows count along ``owner``."""
    lens = np.array([len(sets[i]) for i in owner], np.int64)
    flat = mix(np.concatenate([sets[i] for i in owner]) + np.uint64(seed) * _BASE)
    parts = k[band] // 2 + 1
    cells = 3 * (parts + _spare(parts))
    base = np.cumsum(cells) - cells
    cell = ((flat >> np.uint64(32)) * np.repeat(cells, lens).astype(np.uint64)) >> np.uint64(32)
    cell = cell.astype(np.int64) + np.repeat(base, lens)
    total = np.zeros(int(cells.sum()), np.uint64)
    np.add.at(total, cell, flat * _BASE ^ flat >> np.uint64(29))
    count = np.bincount(cell, minlength=len(total))
    first = np.repeat(base // 3, used) + np.arange(int(used.sum())) - np.repeat(np.cumsum(used) - used, used)
    total, count = total.reshape(-1, 3)[first], count.reshape(-1, 3)[first]
    of = np.repeat(np.arange(len(owner)), used)
    part = first - (base // 3)[of]
    label = (band[of].astype(np.uint64) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(2)) + np.uint64(seed << 60)
    sums = total.sum(axis=1, keepdims=True, dtype=np.uint64) - total
    held = count.sum(axis=1, keepdims=True) - count
    sig = mix(sums * _BASE + mix(label)[:, None] + np.arange(3, dtype=np.uint64))
    return np.repeat(of, 3), sig.ravel(), held.ravel()


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) for every set. Bands with k = 0 need none: there only equal sets are similar enough.

    A set of a elements differs in at most h = (a + 100 a / percent) (100 - percent) / (100 + percent) from any similar one
    that is no smaller, in its own band or in the next; the parts used must cost more than h differences to be left out.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    first, k = bands(percent, int(sizes.max(initial=1)) * 2)
    own = np.searchsorted(first, sizes, side="right") - 1
    owner = np.concatenate([np.arange(len(sets))] * 2)
    band = np.concatenate([own, own + 1])
    live = (np.concatenate([sizes] * 2) > 0) & (k[np.minimum(band, len(k) - 1)] > 0)
    owner, band = owner[live], band[live]
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, parts = sizes[owner], k[band] // 2 + 1
    apart = np.minimum(k[band], (a + a * 100 // percent) * (100 - percent) // (100 + percent))
    used = parts + _spare(parts)
    row, sig, held = _instance(sets, owner, band, used, k, 0)
    none = held <= WEAK
    if none.any():
        weak = none.reshape(-1, 3).sum(axis=1)
        cost = np.bincount(row[::3], weights=np.where(weak == 0, 2, np.where(weak < 3, 1, 0)), minlength=len(owner))
        odd = none & (cost <= apart)[row]
        row, sig, weak_row, weak_sig = row[~none], sig[~none], row[odd], sig[odd]
        if len(weak_row):
            need = np.unique(weak_row)
            row2, sig2, _ = _instance(sets, owner[need], band[need], used[need], k, 1)
            size2 = np.bincount(row2, minlength=len(need))
            start2 = np.cumsum(size2) - size2
            at = np.searchsorted(need, weak_row)
            rep = size2[at]
            inner = np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(start2[at], rep)
            both = mix(np.repeat(weak_sig, rep) * _BASE + sig2[inner])
            row, sig = np.concatenate([row, np.repeat(weak_row, rep)]), np.concatenate([sig, both])
    return owner[row], sig


def second_signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of the second partition, weak ones too: any two similar sets share one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    first, k = bands(percent, int(sizes.max(initial=1)) * 2)
    own = np.searchsorted(first, sizes, side="right") - 1
    owner, band = np.concatenate([np.arange(len(sets))] * 2), np.concatenate([own, own + 1])
    live = (np.concatenate([sizes] * 2) > 0) & (k[np.minimum(band, len(k) - 1)] > 0)
    owner, band = owner[live], band[live]
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts = k[band] // 2 + 1
    row, sig, _ = _instance(sets, owner, band, parts, k, 1)
    return owner[row], sig


def _profile(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), width)
                bits = pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
                columns = [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, set_ids(sets)), bits]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "k1", "k2", "parity"])

    return run


_PACKED = "kind int, g int, nodes binary, sizes binary, counts binary, sigs binary"
_FLAG = np.uint32(1 << 31)


def _name(group: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A bucket's name from its group and the low 32 bits of its signature."""
    return (mix(group.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _rows(nodes: np.ndarray, sizes: np.ndarray, row: np.ndarray, sig: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows (kind, group, nodes, their sizes, counts, low 32 bits of the signatures): a signature's group and low bits stand for it until sets are compared.

    Of a signature that very many sets of this slice have, only the smallest node goes to the group, with a flag on its size; the
    others are named at once, in a row of kind 0: (nodes, sizes, centres as counts, names as signatures). So no group
    holds more of a bucket than a few rows of each slice.
    """
    out = {"kind": [], "g": [], "nodes": [], "sizes": [], "counts": [], "sigs": []}
    group = ((sig >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
    sizes = sizes.astype(np.uint32)
    flag = np.zeros(len(sig), np.uint32)
    if len(sig):
        key = np.sort(sig)
        many = key[HEAVY - 1 :][key[HEAVY - 1 :] == key[: max(0, len(key) - HEAVY + 1)]]
        heavy = np.flatnonzero(np.isin(sig, many)) if len(many) else np.zeros(0, np.int64)
        if len(heavy):
            heavy = heavy[np.lexsort((nodes[row[heavy]], sig[heavy]))]
            first = np.flatnonzero(np.r_[True, sig[heavy][1:] != sig[heavy][:-1]])
            head = np.repeat(heavy[first], np.diff(np.r_[first, len(heavy)]))
            out["kind"].append(0)
            out["g"].append(int(group[heavy[0]]))
            out["nodes"].append(nodes[row[heavy]].tobytes())
            out["sizes"].append(np.stack([sizes[row[heavy]], sizes[row[head]]]).tobytes())
            out["counts"].append(nodes[row[head]].tobytes())
            out["sigs"].append(_name(group[heavy], sig[heavy].astype(np.uint32)).tobytes())
            flag[heavy[first]] = _FLAG
            stay = np.ones(len(sig), bool)
            stay[np.setdiff1d(heavy, heavy[first])] = False
            row, sig, group, flag = row[stay], sig[stay], group[stay], flag[stay]
    order = np.argsort(group * max(1, len(nodes)) + row)
    group, row, low, flag = group[order], row[order], sig[order].astype(np.uint32), flag[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for a, b in zip(starts, np.r_[starts[1:], len(group)] if len(group) else [], strict=True):
        # A node with flagged signatures stands twice, once for those.
        ids, at, counts = np.unique(row[a:b] * 2 + (flag[a:b] > 0), return_inverse=True, return_counts=True)
        within = np.argsort(at, kind="stable")
        out["kind"].append(1)
        out["g"].append(int(group[a]))
        out["nodes"].append(nodes[ids // 2].tobytes())
        out["sizes"].append((sizes[ids // 2] | np.where(ids % 2, _FLAG, 0).astype(np.uint32)).tobytes())
        out["counts"].append(counts.astype(np.uint32).tobytes())
        out["sigs"].append(low[a:b][within].tobytes())
    columns = [pa.array(out[c], pa.int32()) for c in ("kind", "g")] + [pa.array(out[c], pa.binary()) for c in list(out)[2:]]
    return pa.RecordBatch.from_arrays(columns, names=list(out))


def _packed(width: int, percent: int, groups: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), width)
                k1, k2 = set_ids(sets)
                once = np.unique(np.stack([k1, k2]), axis=1, return_index=True)[1]
                sets = [sets[i] for i in once]
                yield _rows(k1[once], np.array([len(s) for s in sets], np.uint32), *signatures(sets, percent), groups)

    return run


def _dealt_again(width: int, percent: int, groups: int):
    """Signatures (large bucket, signature of the second partition) of texts with the names of their large buckets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1, SLICE_BYTES // 8):
                sets = shingle_sets(part.column(1), width)
                nodes = set_ids(sets)[0]
                fit = np.flatnonzero(nodes == np.asarray(part.column(3), np.int64))  # of rows that repeat an id, the one that is meant
                fit = fit[np.unique(nodes[fit], return_index=True)[1]]
                lists = [np.array(x, np.int64) for x in part.column(2).take(pa.array(fit)).to_pylist()]
                sets, nodes = [sets[i] for i in fit], nodes[fit]
                row, sig = second_signatures(sets, percent)
                order = np.argsort(row, kind="stable")
                row, sig = row[order], sig[order]
                edge = np.searchsorted(row, np.arange(len(sets) + 1))
                both = [mix((x.astype(np.uint64) * _BASE)[:, None] + sig[a:b][None, :]).ravel() for x, a, b in zip(lists, edge[:-1], edge[1:], strict=True)]
                rows = np.repeat(np.arange(len(sets)), [len(x) for x in both])
                yield _rows(nodes, np.array([len(s) for s in sets], np.uint32), rows, np.concatenate(both) if both else np.zeros(0, np.uint64), groups)

    return run


def _buckets(group: int, nodes: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, node, bucket's name) for nodes that share a signature with a smaller one; the name is 0 for buckets of two.

    Buckets of the same members come once; they are named by them, and those that slices stand behind by their signature. Buckets of two
    whose sizes are too far apart are left out; in larger ones a node whose size is too far from the centre's has itself as centre.
    """
    flagged, sizes = sizes >= _FLAG, (sizes & ~_FLAG).astype(np.int64)
    order = np.lexsort((nodes, sigs))
    sigs, nodes, sizes, flagged = sigs[order], nodes[order], sizes[order], flagged[order]
    keep = np.r_[True, (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])]
    start = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, np.int64)
    slices_behind = np.maximum.reduceat(flagged, start) if len(start) else np.zeros(0, bool)
    sigs, nodes, sizes = sigs[keep], nodes[keep], sizes[keep]
    start = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else start
    size = np.diff(np.r_[start, len(sigs)])
    name = np.add.reduceat(mix(nodes), start) if len(start) else np.zeros(0, np.uint64)
    plain = np.flatnonzero((size > 1) & ~slices_behind)
    big = np.r_[plain[np.unique(name[plain], return_index=True)[1]], np.flatnonzero(slices_behind)]
    label = np.where(slices_behind[big], _name(np.full(len(big), group), sigs[start[big]]), np.where(size[big] > 2, (name[big] >> np.uint64(1)).astype(np.int64), 0))
    rep = size[big]
    at = np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(start[big], rep)
    first, label = np.repeat(start[big], rep), np.repeat(label, rep)
    near = 100 * np.minimum(sizes[at], sizes[first]) >= percent * np.maximum(sizes[at], sizes[first])
    live = near | (label != 0)
    return np.where(near, nodes[first], nodes[at])[live], nodes[at][live], label[live]


def _search(percent: int):
    def told(centre, node, label):
        wide, apart = label != 0, centre != node
        pair = np.unique(np.stack([centre, node])[:, apart], axis=1) if apart.any() else np.zeros((2, 0), np.int64)
        rows = np.r_[np.zeros(pair.shape[1], np.int64), label[wide]], np.r_[pair[0], np.zeros(int(wide.sum()), np.int64)], np.r_[pair[1], node[wide]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["bucket", "centre", "node"])

    def done(group, held):
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in held])
        nodes, sizes = (np.repeat(np.concatenate([np.frombuffer(r[c], t) for r in held]), counts) for c, t in (("nodes", np.int64), ("sizes", np.uint32)))
        return told(*_buckets(group, nodes, sizes, np.concatenate([np.frombuffer(r["sigs"], np.uint32) for r in held]), percent))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in it:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    node, centre, label = (np.frombuffer(r[c], np.int64) for c in ("nodes", "counts", "sigs"))
                    n, m = np.frombuffer(r["sizes"], np.uint32).astype(np.int64).reshape(2, -1)
                    yield told(np.where(100 * np.minimum(n, m) >= percent * np.maximum(n, m), centre, node), node, label)
                    continue
                if now is not None and r["g"] != now:
                    yield done(now, held)
                    held = []
                now = r["g"]
                held.append(r)
        if held:
            yield done(now, held)

    return run


def _forest(percent: int, every: bool):
    """(a, b, sure) that may join the components of a bucket, among nodes whose sizes and parities allow the similarity.

    Rows (bucket, i, j, block, node, component, n, parity, other) come sorted by (bucket, i, j): the members of the blocks i and j of a bucket, and, with
    ``other``, pairs (node, other) already found unlike, which are not asked for again. Of a node's pairs with a component the likest stands
    for all, and the two count as joined, if its parities leave room for what they hide: it is sure. Else all of them are asked for, as with
    ``every``. So there are fewer sure pairs than members, and the others are those about the limit alone. A task asks for a pair once.
    """

    def of(t: pa.RecordBatch):
        other = t.column("other")
        member = np.asarray(other.is_null())
        node = np.asarray(t.column("node"), np.int64)
        unlike: dict[int, set[int]] = {}
        for x, y in zip(node[~member].tolist(), other.filter(pa.array(~member)).to_pylist(), strict=True):
            unlike.setdefault(x, set()).add(y)
        t = t.filter(pa.array(member)).take(pa.array(np.argsort(node[member], kind="stable")))
        node, n, block = (np.asarray(t.column(c), np.int64) for c in ("node", "n", "block"))
        bits = folded(t.column("parity"))
        label = np.unique(np.asarray(t.column("component"), np.int64), return_inverse=True)[1]
        across = len(t) and t.column("i")[0].as_py() != t.column("j")[0].as_py()
        out = []
        for k in range(len(node) - 1):
            if (label == label[k]).all():
                break
            rest = slice(k + 1, None)
            near = (label[rest] != label[k]) & (100 * np.minimum(n[k], n[rest]) >= percent * np.maximum(n[k], n[rest]))
            if across:
                near &= block[rest] != block[k]
            at = np.flatnonzero(near) + k + 1
            apart = np.bitwise_count((bits[at] ^ bits[k]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            ok = apart * (100 + percent) <= (n[k] + n[at]) * (100 - percent)
            if int(node[k]) in unlike:
                ok &= ~np.isin(node[at], np.fromiter(unlike[int(node[k])], np.int64))
            at, apart = at[ok], apart[ok]
            if not len(at):
                continue
            likest = np.argsort(apart, kind="stable")
            at, apart = at[likest], apart[likest]
            found, first = np.unique(label[at], return_index=True)
            hidden = 2 + apart[first] ** 2 // (32 * bits.shape[1])  # differences that meet on a bit, about
            safe = ((apart[first] + hidden) * (100 + percent) <= (n[k] + n[at[first]]) * (100 - percent)) & (not every)
            rest_of = at[~np.isin(label[at], found[safe])]
            sure_of = at[first][safe]
            label[np.isin(label, found[safe])] = label[k]
            out.append(np.stack([np.full(len(rest_of) + len(sure_of), node[k]), np.r_[node[sure_of], node[rest_of]], np.r_[np.ones(len(sure_of), np.int64), np.zeros(len(rest_of), np.int64)]]))
        return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)

    def told(pairs: list[np.ndarray]) -> pa.RecordBatch:
        a, b, sure = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure > 0)], names=["a", "b", "sure"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = [], 0
        for asked in map(of, by_key(it, ("bucket", "i", "j"))):
            if asked.shape[1]:
                pairs.append(asked)
                n += asked.shape[1]
            if n > 1 << 20:
                yield told(pairs)
                pairs, n = [], 0
        if pairs:
            yield told(pairs)

    return run


def _sets(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), width)
                columns = [part.column(0).cast(pa.int64()), *map(pa.array, set_ids(sets)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "k1", "k2", "shingles"])

    return run


def _compare(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batch.column(0), batch.column(1)
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose sizes and parities allow the similarity; a pair that is similar enough is never dropped."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("parity").alias(f"p{n}"))
    half = lambda p: F.zip_with(F.slice(p, F.lit(1), F.shiftright(F.size(p), 1)), F.slice(p, F.shiftright(F.size(p), 1) + 1, F.size(p)), lambda x, y: x.bitwiseXOR(y))
    # Sizes that are near enough have widths that are the same, or one twice the other.
    fold = lambda p, q: F.when(F.size(p) > F.size(q), half(F.col(p))).otherwise(F.col(p))
    bits = F.aggregate(F.zip_with(fold("pa", "pb"), fold("pb", "pa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (bits * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b of nodes) that are similar enough, by their whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = docs.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(width), "node long, k1 long, k2 long, shingles binary")
    sets = cut(sets.join(nodes.select("node", "k1", "k2"), ["node", "k1", "k2"], "left_semi").dropDuplicates(["node", "k1", "k2"]), "ngram-sets")
    one, two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    same = pairs.select("a", "b").join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(_compare(percent), "a long, b long")
    return same.distinct()


def ngram_components(docs: DataFrame, *, width: int = 5, percent: int = 80, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of similarity ``percent``).

    Documents with equal sets (by 127 bits and the size) are one node, the smallest of them. Each node is compared with the smallest of
    its buckets; then each bucket whose members are in several components is asked for pairs that would join them, and again where a pair
    that stood for others was none. So every pair that shares a signature is compared, ruled out, or in one component already. Buckets of more than ``hot`` members are first dealt out by signatures of the second
    partition, of which similar sets share one as well; those still larger are compared block by block.
    Null, empty and wordless texts have no shingles and stay alone. Rows without an id are left out; rows that repeat
    an id are one document, which is linked by the set of each, and give a row each. Other columns are not looked at. Texts are read whole.
    """
    spark, docs = docs.sparkSession, long_doc(docs)
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = partitions(spark, volume / 6 * 0.9, GROUP_SIGNATURES)
    profile = cut(docs.mapInArrow(_profile(width), "doc_id long, n_shingles long, k1 long, k2 long, parity array<long>"), "ngram-profile")
    alike = ["k1", "k2", "n_shingles"]
    nodes = profile.where("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("node"), F.first("parity").alias("parity"))
    nodes = cut(nodes.withColumn("n", F.col("n_shingles")), "ngram-nodes")
    name = nodes.select("k1", "node")
    placed = profile.select("doc_id", *alike).join(nodes.select(*alike, "node"), alike, "left").select("doc_id", "n_shingles", "node")
    # An id whose rows have different sets.
    several = placed.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("b")).where(F.size("b") > 1).select("a", F.explode("b").alias("b")).where("a <> b")

    def search(packed: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """(pairs, members of buckets) of nodes from packed signatures."""
        dealt = packed.repartitionById(groups, "g").sortWithinPartitions("kind", "g")
        found = cut(dealt.mapInArrow(_search(percent), "bucket long, centre long, node long").distinct(), label)
        of = lambda k, to: name.select(F.col("k1").alias(k), F.col("node").alias(to))
        pairs = found.where("bucket = 0").join(of("centre", "a"), "centre").join(of("node", "b"), "node").where("a <> b")
        members = found.where("bucket <> 0").select("bucket", F.col("node").alias("k1")).join(name, "k1").select("bucket", "node").distinct()
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), members

    pairs, members = search(docs.mapInArrow(_packed(width, percent, groups), _PACKED), "ngram-buckets")
    tried = cut(_near(pairs, nodes, percent), "ngram-pairs")
    edges = cut(several.union(_verified(tried, docs, nodes, width, percent)), "ngram-links")
    labels = components(edges, "a", "b", "ngram-components")

    def opened(members: DataFrame) -> DataFrame:
        """Members of buckets that are in more than one component, with it."""
        named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
        return named.join(split.select("bucket", "m"), "bucket")

    first = cut(opened(members), "ngram-open")
    members = first.where(F.col("m") <= hot).select("bucket", "node", F.lit(1).alias("blocks"))
    large = cut(first.where(F.col("m") > hot).groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "ngram-large")  # no more of them than a text has signatures
    if large.head(1):
        wanted = large.join(nodes, "node").select(F.col("node").alias("doc_id"), "buckets", "k1")
        texts = docs.join(wanted, "doc_id").select("doc_id", "text", "buckets", "k1")
        more, again = search(texts.mapInArrow(_dealt_again(width, percent, groups), _PACKED), "ngram-again")
        sizes = again.groupBy("bucket").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks"))
        members = members.union(again.join(sizes, "bucket").select("bucket", "node", "blocks"))
        more = cut(_near(more, nodes, percent).join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        edges = cut(edges.union(_verified(more, docs, nodes, width, percent)), "ngram-links")
        tried = tried.union(more)
        labels = components(edges, "a", "b", "ngram-components")
    members = cut(members, "ngram-members")
    block = lambda node: F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    for turn in itertools.count(1):
        rows = opened(members).withColumn("block", block("node"))
        unlike = tried.join(edges, ["a", "b"], "left_anti")
        other = members.select("bucket", F.col("node").alias("b"))
        unlike = members.withColumnRenamed("node", "a").join(unlike, "a").join(other, ["bucket", "b"]).withColumns({"x": block("a"), "y": block("b")})
        rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(nodes.select("node", "n", "parity"), "node")
        rows = rows.select("bucket", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "node", "component", "n", "parity", F.lit(None).cast("long").alias("other"))
        none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("block", "component", "n", "parity")}
        rows = rows.unionByName(unlike.select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.col("a").alias("node"), F.col("b").alias("other")).withColumns(none))
        key = ("bucket", "i", "j")
        out = cut(rows.repartition(groups, *key).sortWithinPartitions(*key).mapInArrow(_forest(percent, turn > ROUNDS), "a long, b long, sure boolean"), "ngram-asked")
        fresh = cut(out.groupBy("a", "b").agg(F.bool_or("sure").alias("sure")).join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        if not fresh.head(1):
            break
        found = cut(_verified(fresh, docs, nodes, width, percent), "ngram-found")
        tried = tried.union(fresh.select("a", "b"))
        if found.head(1):  # else the components stay as they are
            edges = edges.union(found)
            labels = components(edges, "a", "b", "ngram-components")
        wrong = cut(fresh.where("sure").select("a", "b").join(found, ["a", "b"], "left_anti"), "ngram-wrong")
        if not wrong.head(1):
            break
        # Buckets in which a pair that seemed sure stood for others.
        again = members.withColumnRenamed("node", "a").join(wrong, "a").join(other, ["bucket", "b"]).select("bucket").distinct()
        members = cut(members.join(again, "bucket", "left_semi"), "ngram-members")
    named = placed.join(labels, "node", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
