"""N-gram Jaccard join: R-trees over count vectors, whose pages are dealt by cells of the vector space.

Every text becomes its set of distinct k-word shingles, and equal sets become one
*class*.  Two classes link when ``100 * intersection >= percent * union``.  Shingles are
hashed into groups; the counts of a set's groups are a point, and the sum of the lesser
coordinates of two points bounds the overlap of their sets from above.

1. *Cells.*  A pair that links differs in at most ``D = floor(min_size * (100 - percent) /
   percent)`` shingles, so of G > D fine groups it agrees on at least G - D: same count,
   same shingles.  A cell holds the classes that agree on one fine group; every pair that
   links shares one, and no pair of unlike sizes meets (G is fixed per size band, and a set
   enters each band its partners may be in).  Cells link nothing by themselves.
2. *Regions.*  Cells overlap, so a pair would be found again and again.  Regions are
   disjoint: members of a cell join its most shared member where the bound allows a link;
   then, where a cell still has several regions, an R-tree over its members' points finds
   those regions that the bound cannot keep apart.  Now every pair that links lies in one region.
3. *R-tree join.*  Each region is a packed R-tree of points joined with itself (regions
   beyond ``LEAF`` members: with each other block of the region): two nodes are descended
   together unless the sum of the lesser upper bounds of their coordinates is below the
   overlap that their sizes need.  Every link comes from here.
4. *Verification.*  Surviving pairs are verified on their sets; links are counted, and
   components found.

Exact for 54-bit shingle hashes.  Work follows the input: hot cells pass through salted
overflow buckets, cells and regions beyond ``LEAF`` members are dealt in blocks, and what
crosses blocks is connected by distributed stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scan
from ._store import drop, table, written
from .graph import components, least_reached

#: Coordinates of a count vector, and of the coarser points (sums of neighbours) that nodes of a tree bound.
DIMS, COARSE = 256, 32
#: Greatest count that is kept; a vector that reaches it is never ruled out.
FULL = (1 << 8) - 1
#: Ratio of neighbouring size bands.
BAND = 1.2
#: Members of one cell that a mapper sends to the cell's own bucket, which shows that it is shared; the rest go to salted buckets.
HOT = 2
#: Keys that a mapper sorts and sends at once (some 100 bytes each while they are sorted), and keys of a bucket.
HELD, BUCKET_KEYS = 300_000, 200_000
#: Members of a cell or region that one R-tree holds; larger ones are dealt in blocks.
LEAF = 2048
#: Rows of small cells that share a call.
CALL_ROWS = 8192
#: Shingles that one block of a region holds, and columns of a block that are multiplied at once.
BLOCK, COLUMNS = 1_000_000, 1024
#: Rows of an id table that may be broadcast (16 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 1_000_000
_NODE = 16
_COEF = _scan.mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


class Sets:
    """The shingle sets of many texts: ascending hashes of all rows after each other, and n + 1 row offsets."""

    def __init__(self, h: np.ndarray, rows: np.ndarray, k: int):
        n = np.diff(rows)
        row = np.repeat(np.arange(len(n)), n)
        if not len(h):
            self.hash, self.row, self.at = h, row, np.zeros(len(n) + 1, np.int64)
            return
        left = rows[1:][row] - np.arange(len(h))  # words from here to the end of the row
        out, parts = h * _COEF[0], min(k, len(h))
        for j in range(1, parts):
            out[:-j] += np.where(left[:-j] > j, h[j:] * _COEF[j], np.uint64(0))
        # a text of fewer words is one shingle, made of all of them
        out += np.minimum(left, k).astype(np.uint64)
        keep = (left >= k) | ((n[row] < k) & (left == n[row]))
        bits = np.uint64(64 - ROW_BITS)
        key = (row[keep].astype(np.uint64) << bits) | (_scan.mix(out[keep]) >> np.uint64(ROW_BITS))
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        self.row = (key >> bits).astype(np.int64)
        self.hash = key & ((np.uint64(1) << bits) - np.uint64(1))
        self.at = np.searchsorted(self.row, np.arange(len(n) + 1))

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.hash[self.at[i] : self.at[i + 1]]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of ``x`` over each row's set, modulo 2**64."""
        cs = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        return cs[self.at[1:]] - cs[self.at[:-1]]

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def ids(self) -> np.ndarray:
        """64-bit identity of each set."""
        a = self.sums(_scan.mix(self.hash))
        b = self.sums(_scan.mix(self.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        return _scan.mix(a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ self.sizes().astype(np.uint64)).view(np.int64)

    def counts(self) -> np.ndarray:
        """Count vectors: shingles in each of DIMS hash groups."""
        g = (self.hash % np.uint64(DIMS)).astype(np.int64)
        return np.minimum(np.bincount(self.row * DIMS + g, minlength=len(self) * DIMS), FULL).astype(np.uint8).reshape(len(self), DIMS)


#: Bits of a key that number the row within a slice; the shingle hash has the other 54.
ROW_BITS = 10


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1 << ROW_BITS):
            for part in _scan.slices(batch.slice(lo, 1 << ROW_BITS), "text"):
                buf, offs = _scan.buffers(part.column(part.schema.get_field_index("text")))
                _, _, h, rows = _scan.words(buf, offs)
                yield part, Sets(h, rows, k)


def bands(size: int) -> np.ndarray:
    """Lower ends of the size bands, past ``size``."""
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array([*out, max(out[-1] + 1, int(out[-1] * BAND))])


def signatures(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the groups of every set, for each size band in which a partner may be the smaller set.

    Two sets that link differ in at most D shingles, so of G = D + 1 + spare groups they
    agree on 1 + spare.  Groups of at most ``small_size`` shingles are left out where there are no
    more than ``spare`` of them: one group that both keep is still the same in both.
    """
    n, limit = sets.sizes(), small_size(percent)
    low = bands(int(n.max(initial=0)))
    band = np.searchsorted(low, n, "right") - 1
    rows, keys = [], []
    back = 0
    while True:
        at = band - back
        top = low[np.maximum(at, 0) + 1] - 1  # greatest size of the smaller set
        on = (n > 0) & (at >= 0) & (100 * top >= percent * n)
        if not on.any():
            return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        differ = top * (100 - percent) // percent
        on &= differ > 0
        spare = np.ceil(SPARE * (differ + 1)).astype(np.int64)
        groups = np.where(on, differ + 1 + spare, 0)
        base = np.concatenate(([0], np.cumsum(groups)))
        tag = _scan.mix(at.astype(np.uint64) + np.uint64(77))
        use = on[sets.row]
        s, r = sets.hash[use], sets.row[use]
        to = base[r] + (((_scan.mix(s ^ tag[r]) >> np.uint64(32)) * groups[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        v = _scan.mix(s + np.uint64(1))
        lo = np.bincount(to, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1])
        hi = np.bincount(to, (v >> np.uint64(32)).astype(np.float64), base[-1])
        size = np.bincount(to, minlength=base[-1])
        row = np.repeat(np.arange(len(n)), groups)
        key = lo.astype(np.uint64) + (hi.astype(np.uint64) << np.uint64(32))
        key = _scan.mix(key ^ _scan.mix(tag[row] + (np.arange(base[-1]) - base[row]).astype(np.uint64)))
        small = size <= limit
        few = np.bincount(row, small, len(n)) <= spare
        keep = ~(small & few[row])
        rows.append(row[keep])
        keys.append(key[keep])
        back += 1


#: Further groups, as a part of those needed.
SPARE = 0.1


def small_size(percent: int) -> int:
    """Size up to which groups are left out: so large that, of random groups, half of the spare ones reach it."""
    mean = percent / (100 - percent) / (1 + SPARE)
    z, term = 0, np.exp(-mean)
    total = term
    while total + term * mean / (z + 1) <= SPARE / 2:
        z += 1
        term *= mean / z
        total += term
    return z


def _info(k: int):
    def run(batches):
        for part, sets in sets_of(batches, k):
            n = sets.sizes()
            yield pa.record_batch([part.column(0), pa.array(n), pa.array(sets.ids(), mask=n == 0)], ["doc_id", "n_shingles", "set_id"])

    return run


def _signatures(k: int, percent: int, buckets: int):
    def flush(keys: list, ids: list) -> Iterator[pa.RecordBatch]:
        if not any(map(len, keys)):
            return
        key, own = _distinct(np.concatenate(keys), np.concatenate(ids))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.flatnonzero(first)
        nth = np.arange(len(key)) - start[np.cumsum(first) - 1]
        to = (key % np.uint64(buckets)).astype(np.int64)
        hot = nth >= HOT  # already known to be shared: salted
        to[hot] = buckets + (_scan.mix(key[hot] ^ own[hot].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to.astype(np.int32), kind="stable")
        to, key, own = to[order], key[order], own[order]
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        ends = np.append(cut[1:], len(to))
        for lo in range(0, len(cut), 256):
            a, z = cut[lo : lo + 256], ends[lo : lo + 256]
            yield pa.record_batch(
                [pa.array(to[a].astype(np.int32)), pa.array([key[i:j].tobytes() for i, j in zip(a, z)], pa.binary()), pa.array([own[i:j].tobytes() for i, j in zip(a, z)], pa.binary())],
                ["bucket", "keys", "ids"],
            )

    def run(batches):
        keys, ids, held = [], [], 0
        for _, sets in sets_of(batches, k):
            row, key = signatures(sets, percent)
            keys.append(key)
            ids.append(sets.ids()[row])
            held += len(key)
            if held > HELD:
                yield from flush(keys, ids)
                keys, ids, held = [], [], 0
        yield from flush(keys, ids)

    return run


def _distinct(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, those of a key together."""
    order = np.argsort(key)
    key, own = key[order], own[order]
    again = np.flatnonzero(np.diff(key) == 0)
    if len(again):  # only keys with several rows need their ids in order
        many = np.zeros(len(key), bool)
        many[again] = many[again + 1] = True
        at = np.flatnonzero(many)
        sub = np.lexsort((own[at], key[at]))
        key[at], own[at] = key[at][sub], own[at][sub]
        keep = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        key, own = key[keep], own[keep]
    return key, own


def _shared(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()])
        own = np.concatenate([np.frombuffer(x, np.int64) for x in t["ids"].to_pylist()])
        key, own = _distinct(key, own)
        _scan.trim()
        if t["bucket"][0].as_py() < buckets:
            same = key[1:] == key[:-1]
            many = np.append(False, same) | np.append(same, False)
            key, own = key[many], own[many]
        return pa.table([pa.array(key.view(np.int64)), pa.array(own)], ["key", "set_id"])

    return run


def overlap_needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection with which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


class Points:
    """Count vectors with the sizes of their sets; a vector that reaches FULL is never ruled out."""

    def __init__(self, vec: np.ndarray, size: np.ndarray):
        self.vec, self.size, self.full = vec, size, (vec == FULL).any(1)

    def may_link(self, i: np.ndarray, other: Points, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the points i of these and j of the others allow a link."""
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 13):
            a, b = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
            bound = np.minimum(self.vec[a], other.vec[b]).sum(1, dtype=np.int32)
            out[at : at + len(a)] = (bound >= overlap_needed(self.size[a], other.size[b], percent)) | self.full[a] | other.full[b]
        return out


class RTree:
    """Packed R-tree of count vectors: leaves hold ``_NODE`` points sorted by size and first coordinates."""

    def __init__(self, vec: np.ndarray, size: np.ndarray):
        low = vec.reshape(len(vec), COARSE, DIMS // COARSE).sum(2, dtype=np.int32)
        low[(vec == FULL).any(1)] = 1 << 24
        self.order = np.lexsort((low[:, 1], low[:, 0], size)) if len(vec) else np.zeros(0, np.int64)
        self.points = Points(vec[self.order], size[self.order])
        self.levels = []  # (high coordinates, least size, greatest size), nodes of _NODE entries of the level below
        hi, least, most = low[self.order], size[self.order], size[self.order]
        while True:
            self.levels.append((hi, least, most))
            if len(hi) <= _NODE:
                break
            cut = np.arange(0, len(hi), _NODE)
            hi, least, most = np.maximum.reduceat(hi, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)

    def join(self, other: RTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the arrays given) of the points of this and the other tree whose bound allows a link; of one tree with itself each pair once."""
        same = self is other
        found = []
        stack = [(max(len(self.levels), len(other.levels)) - 1, *self._tops(other))]
        while stack:
            level, i, j = stack.pop()
            most = 1 << 11 if level else 1 << 16  # a part at a time, deepest first, so that what waits stays small
            if len(i) > most:
                stack.append((level, i[most:], j[most:]))
                i, j = i[:most], j[:most]
            (hi_a, lo_a, up_a), (hi_b, lo_b, up_b) = self._level(level), other._level(level)
            ok = (100 * up_a[i] >= percent * lo_b[j]) & (100 * up_b[j] >= percent * lo_a[i])
            i, j = i[ok], j[ok]
            if not level:
                ok = i < j if same else np.ones(len(i), bool)
                i, j = i[ok], j[ok]
                ok = self.points.may_link(i, other.points, j, percent)
                found.append((self.order[i[ok]], other.order[j[ok]]))
                continue
            ok = np.minimum(hi_a[i], hi_b[j]).sum(1, dtype=np.int64) >= overlap_needed(lo_a[i], lo_b[j], percent)
            a, b = self._below(level, i[ok]), other._below(level, j[ok])
            x, y = np.repeat(a, b.shape[1], 1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
            ok = (x >= 0) & (y >= 0)
            if same:
                ok &= x <= y
            if ok.any():
                stack.append((level - 1, x[ok], y[ok]))
        return tuple(np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in (0, 1))

    def _level(self, level: int) -> tuple:
        return self.levels[min(level, len(self.levels) - 1)]

    def _tops(self, other: RTree) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.levels[-1][0]), len(other.levels[-1][0])
        i, j = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        return (i[i <= j], j[i <= j]) if self is other else (i, j)

    def _below(self, level: int, i: np.ndarray) -> np.ndarray:
        """The entries of nodes i (-1: none); a tree that is lower than the other waits."""
        if level > len(self.levels) - 1:
            return i[:, None]
        out = i[:, None] * _NODE + np.arange(_NODE)
        out[out >= len(self.levels[level - 1][0])] = -1
        return out


def _between_regions(percent: int):
    def cell(region, size, side, vec) -> list:
        """Pairs of regions of one dealt cell that the bound cannot keep apart."""
        left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0)) if (side < 2).any() else (np.arange(len(side)),) * 2
        if not len(left) or not len(right):
            return []
        a = RTree(vec[left], size[left])
        i, j = a.join(a if (side == 2).all() else RTree(vec[right], size[right]), percent)
        x, y = region[left[i]], region[right[j]]
        pair = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y]
        return [np.unique(pair, axis=0)] if len(pair) else []

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("t", "ascending"), ("i", "ascending"), ("j", "ascending")])
        marks = [t[c].to_numpy() for c in ("key", "t", "i", "j")]
        cut = np.flatnonzero(np.any([np.concatenate(([True], m[1:] != m[:-1])) for m in marks], 0))
        cols = [t[c].to_numpy() for c in ("region", "n", "side")]
        cols.append(np.frombuffer(b"".join(t["vec"].to_pylist()), np.uint8).reshape(-1, DIMS))
        found = [p for a, z in zip(cut, [*cut[1:], len(t)]) for p in cell(*(c[a:z] for c in cols))]
        pair = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        _scan.trim()
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches):
        for _, sets in sets_of(batches, k):
            has = np.flatnonzero(sets.sizes())
            vec = sets.counts()
            yield pa.record_batch([pa.array(sets.ids()[has]), pa.array(sets.sizes()[has]), pa.array([vec[i].tobytes() for i in has], pa.binary()), pa.array([sets[i].tobytes() for i in has], pa.binary())], ["set_id", "n", "vec", "shingles"])

    return run


def _allowed(percent: int):
    def run(batches):
        for t in batches:
            a, b, n, m, x, y = (t.column(t.schema.get_field_index(c)) for c in ("a", "b", "n", "m", "x", "y"))
            x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, DIMS) for v in (x, y))
            every = np.arange(len(x))
            keep = pa.array(Points(x, n.to_numpy()).may_link(every, Points(y, m.to_numpy()), every, percent), pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])
        _scan.trim()

    return run


def _overlaps(h: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``h[at[i]:at[i + 1]]`` and those of j."""
    n = len(at) - 1
    if len(i) <= 8 * n:
        out = np.zeros(len(i), np.int64)
        for x, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
            a, b = h[at[p] : at[p + 1]], h[at[q] : at[q + 1]]
            out[x] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
        return out
    # most pairs are wanted: products of the sets' indicators, some columns at a time
    left, right = np.unique(i), np.unique(j)
    row = np.repeat(np.arange(n), np.diff(at))
    _, col, freq = np.unique(h, return_inverse=True, return_counts=True)
    use = (freq > 1) & (freq < n)  # a shingle of one set is in no intersection, one of all sets in each
    keep = use[col]
    row, col = row[keep], (np.cumsum(use) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.full((len(left), len(right)), (freq == n).sum(), np.float32)  # below 2**24, as BLOCK is
    for lo in range(0, int(use.sum()), COLUMNS):
        a, z = np.searchsorted(col, (lo, lo + COLUMNS))
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[a:z], col[a:z] - lo] = 1
        both += m[left] @ m[right].T
    return both[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)


def _small_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups of at most ``_NODE`` neighbours (each is one node of a tree)."""
    p, q = np.triu_indices(_NODE, 1)
    g, t = np.nonzero(q[None] < sizes[:, None])
    first = np.cumsum(sizes) - sizes
    return first[g] + p[t], first[g] + q[t]


def _joined(ids: np.ndarray, side: np.ndarray, n: np.ndarray, vec: np.ndarray, h: np.ndarray, at: np.ndarray, cut: np.ndarray, alone: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set, set that names its component) of the blocks that begin at ``cut``; the pairs of a block that isn't ``alone`` are those across its two sides."""
    ends = np.append(cut[1:], len(ids))
    small = (ends - cut <= _NODE) & alone
    own = np.flatnonzero(np.repeat(small, ends - cut))
    i, j = _small_pairs((ends - cut)[small]) if small.any() else (own, own)
    i, j = own[i], own[j]
    ok = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
    i, j = i[ok], j[ok]
    points = Points(vec, n)
    ok = points.may_link(i, points, j, percent)
    pairs = [(i[ok], j[ok])]
    for a, z, one in zip(cut[~small].tolist(), ends[~small].tolist(), alone[~small].tolist()):
        first = z if one else a + int((side[a:z] == 0).sum())
        tree = RTree(vec[a:first], n[a:first])
        if one:
            i, j = tree.join(tree, percent)
            i, j = a + i, a + j
        else:
            i, j = tree.join(RTree(vec[first:z], n[first:z]), percent)
            i, j = a + i, first + j
        pairs.append((i, j))
    out, links = np.zeros(len(ids), np.int64), []
    for i, j in pairs:
        if len(i):
            lo, hi = int(min(i.min(), j.min())), int(max(i.max(), j.max())) + 1
            both = _overlaps(h[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], i - lo, j - lo)
            ok = 100 * both >= percent * (n[i] + n[j] - both)
            links.append((i[ok], j[ok]))
            out += np.bincount(i[ok], minlength=len(ids)) + np.bincount(j[ok], minlength=len(ids))
    i, j = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
    return out, ids[least_reached(i, j, len(ids))]


def _links(percent: int):
    def flush(parts: list) -> pa.RecordBatch:
        mark, ids, side, n, vec, h = (np.concatenate([p[x] for p in parts]) for x in range(6))
        at = np.concatenate(([0], np.cumsum(n)))
        cut = np.flatnonzero(np.concatenate(([True], np.any(mark[1:] != mark[:-1], 1))))
        links, to = _joined(ids, side, n, vec, h, at, cut, mark[cut, 1] == mark[cut, 2], percent)
        return pa.record_batch([pa.array(ids), pa.array(links), pa.array(to), pa.array(mark[:, 3] == 1)], ["set_id", "n_links", "to", "whole"])

    def run(batches):
        """Rows come by root, i, j and side; whole blocks are taken together up to LEAF rows or BLOCK shingles."""
        parts, rows, held, last = [], 0, 0, None
        for t in batches:
            if not t.num_rows:
                continue
            col = lambda c: t.column(t.schema.get_field_index(c))
            mark = np.stack([col(c).to_numpy().astype(np.int64) for c in ("root", "i", "j", "parts")], 1)
            cols = [col(c).to_numpy() for c in ("set_id", "side", "n")]
            vec, raw = (col(c) for c in ("vec", "shingles"))
            cut = np.flatnonzero(np.concatenate(([True], np.any(mark[1:] != mark[:-1], 1))))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), t.num_rows]):
                if parts and tuple(mark[a]) != last and (rows >= LEAF or held >= BLOCK):
                    yield flush(parts)
                    parts, rows, held = [], 0, 0
                last = tuple(mark[a])
                h = np.frombuffer(b"".join(raw.slice(a, z - a).to_pylist()), np.uint64)
                v = np.frombuffer(b"".join(vec.slice(a, z - a).to_pylist()), np.uint8).reshape(-1, DIMS)
                parts.append((mark[a:z], *[c[a:z].copy() for c in cols], v, h))
                rows, held = rows + z - a, held + len(h)
        if parts:
            yield flush(parts)
        _scan.trim()

    return run


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows), marked for broadcast if a count of its rows allows that."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


_PAIR = "a long, b long"


def _regions(spark, cells: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """``set_id, root`` of every class in a shared cell: disjoint regions that no pair that links crosses."""
    shared = cells.join(cells.groupBy("set_id").agg(F.count("*").alias("c")), "set_id")
    pivot = shared.groupBy("key").agg(F.max(F.struct("c", "set_id"))["set_id"].alias("p"))
    star = cells.join(pivot, "key").where("set_id <> p").select(F.least("set_id", "p").alias("a"), F.greatest("set_id", "p").alias("b")).distinct()
    left, right = (points.select(F.col("set_id").alias(x), F.col("n").alias(n), F.col("vec").alias(v)) for x, n, v in (("a", "n", "x"), ("b", "m", "y")))
    close = star.join(left, "a").join(right, "b").where(f"100 * n >= {percent} * m and 100 * m >= {percent} * n")
    first = written(components(close.select("a", "b", "n", "m", "x", "y").mapInArrow(_allowed(percent), _PAIR)), "regions")

    placed = written(cells.join(first.withColumnRenamed("node", "set_id"), "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("region")), "placed")
    tally = placed.groupBy("key", "region").agg(F.count("*").alias("n"))
    state = tally.groupBy("key").agg(F.count("*").alias("regions"), F.max(F.struct("n", "region"))["region"].alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("regions > 1")
    state = written(state, "open-cells")
    rows = state.agg(F.sum("n_all")).first()[0] or 0
    open_ = placed.join(state, "key").join(points, "set_id")
    # side 0: the cell's main region, side 1: the others, side 2: a cell in one block
    na, no = F.ceil(F.col("n_main") / LEAF).cast("int"), F.ceil((F.col("n_all") - F.col("n_main")) / LEAF).cast("int")
    spot = F.pmod(F.xxhash64("set_id"), F.lit(1 << 30))
    main, one = F.col("region") == F.col("main"), F.col("n_all") <= LEAF
    mine = F.pmod(spot, F.when(main, na).otherwise(no)).cast("int")
    ax = F.transform(F.sequence(F.lit(0), no - 1), lambda j: F.struct(F.lit(0).alias("t"), mine.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    oa = F.transform(F.sequence(F.lit(0), na - 1), lambda i: F.struct(F.lit(0).alias("t"), i.alias("i"), mine.alias("j"), F.lit(1).alias("side")))
    oo = F.transform(F.sequence(F.lit(0), no - 1), lambda j: F.struct(F.lit(1).alias("t"), F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), F.lit(2).alias("side")))
    alone = F.array(F.struct(F.lit(2).alias("t"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    dealt = open_.withColumn("at", F.explode(F.when(one, alone).when(main, ax).otherwise(F.concat(oa, oo))))
    dealt = dealt.select("key", "at.t", "at.i", "at.j", "at.side", "set_id", "region", "n", "vec")
    # a dealt block has at most 2 * LEAF members; small cells share a call
    calls = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // CALL_ROWS))
    dealt = dealt.withColumn("call", F.when(F.col("t") == 2, F.pmod(F.xxhash64("key"), F.lit(calls))).otherwise(F.xxhash64("key", "t", "i", "j")))
    again = written(components(dealt.groupBy("call").applyInArrow(_between_regions(percent), _PAIR)), "merged-regions")
    out = written(cells.select("set_id").distinct().join(first.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "in-regions")
    both = out.join(again.select(F.col("node").alias("root"), F.col("root").alias("into")), "root", "left").select("set_id", F.coalesce("into", "root").alias("root"))
    both = written(both, "in-merged-regions")
    drop(spark, first, placed, state, again, out)
    return both


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``.

    ``component_id`` is the least id that links reach, ``n_links`` the number of other
    shingle sets that the document's own set links to.  Words are runs of bytes other
    than ASCII white space, A-Z lower-cased.  Null, empty and blank texts have no shingles
    and stand alone; a text of fewer than ``k`` words is one shingle.  Repeated rows are
    each answered; a null id is kept and never names a component unless it is alone.  The
    id may be of any type that has an order; other columns aren't read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    info = written(base.mapInArrow(_info(k), T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType())])), "info")
    keys = 3 * (info.agg(F.sum("n_shingles")).first()[0] or 0) * (100 - percent) // percent  # about
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), keys // BUCKET_KEYS)
    signed = base.select("text").mapInArrow(_signatures(k, percent, buckets), "bucket int, keys binary, ids binary")
    cells = written(signed.groupBy("bucket").applyInArrow(_shared(buckets), "key long, set_id long"), "cells")
    classes = info.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))

    # the shingle sets of all members of cells, made once more from their texts
    members = cells.select("set_id").distinct()
    wanted = written(classes.join(_bounded(members), "set_id", "left_semi").select("set_id", F.col("doc_id").alias("id")), "wanted")
    texts = base.join(_bounded(wanted.select("id").distinct()), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(k), "set_id long, n long, vec binary, shingles binary")
    sets = written(sets.dropDuplicates(["set_id"]) if _repeats(base) else sets, "sets")

    regions = _regions(spark, cells, sets.select("set_id", "n", "vec"), percent)
    parts = regions.join(sets.select("set_id", "n"), "set_id").groupBy("root").agg(F.greatest(F.ceil(F.count("*") / LEAF), F.ceil(F.sum("n") / BLOCK)).cast("int").alias("parts"), F.count("*").alias("many"))
    parts = written(parts.where("many > 1").select("root", "parts"), "region-sizes")
    inside = regions.join(_bounded(parts), "root").join(sets, "set_id").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    inside = inside.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = inside.select("root", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), (F.col("own") > F.col("to")).cast("int").alias("side"), "parts", "set_id", "n", "vec", "shingles")
    inside = inside.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")
    links = written(inside.mapInArrow(_links(percent), "set_id long, n_links long, to long, whole boolean"), "links")

    # a region in one block has its components already
    across = components(links.where("not whole and set_id <> to").select(F.col("set_id").alias("a"), F.col("to").alias("b")))
    roots = links.where("whole and n_links > 0").select("set_id", F.col("to").alias("root")).unionByName(across.select(F.col("node").alias("set_id"), "root"))
    degree = links.groupBy("set_id").agg(F.sum("n_links").alias("n_links")).where("n_links > 0")
    named = classes.join(roots, "set_id").join(degree, "set_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(named.join(least, "root").select("set_id", "component_id", "n_links"), "set_id", "left")
    named = written(named.select("set_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    out = info.where("set_id is not null").join(named, "set_id").select("doc_id", "n_shingles", "component_id", "n_links")
    out = out.unionByName(info.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    out = written(out, "joined")
    drop(spark, cells, wanted, sets, regions, parts, links, named, info)
    return out


def _repeats(base: DataFrame) -> bool:
    """Whether an id names several rows, so that a set could be made more than once."""
    return base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, over every document."""
    return ngram_join(table(spark, sf_dir, "documents"), k=3, percent=90)
