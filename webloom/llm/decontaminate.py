"""Benchmark decontamination by template windows with slot consistency.

Texts are cut into tokens (runs of letters and digits).  Numbers, units after a number
and names (capitalised inside a sentence) become typed placeholders, everything else is
lower-cased.  Windows of five template tokens are looked up in a hash table of the
benchmark's windows; along one alignment of document and item, the values under the
placeholders must map one to one, so a question with new numbers or names is still found
and a chance meeting of placeholders is not.  Items of fewer tokens are looked up by windows of
their own length; where hardly a word but placeholders is left, the values must be equal.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scan
from ._store import table

#: Words of a window, and the part of an item's windows that a document must hold.
WINDOW, COVER = 5, 0.8
#: Benchmark windows looked up in one pass over the documents (some 40 bytes each are sent to the executors); more take further passes.
PASS_WINDOWS = 2_000_000
#: Plain words that a short item needs for its template to be enough; with fewer, values must be equal.
PLAIN_WORDS = 3
# Unit words that become a placeholder when they follow a number.
UNITS = (
    "km m cm mm mile miles foot feet inch inches yard yards kg g mg lb lbs pound pounds ounce ounces ton tons "
    "l ml litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months "
    "year years percent dollar dollars euro euros cent cents usd eur degrees celsius fahrenheit watt watts volt volts mph kmh"
).split()
_NUM, _UNIT, _NAME = (int(x) for x in _scan.mix(np.array([901, 902, 903], np.uint64)))
_COEF = _scan.mix(np.arange(301, 301 + WINDOW, dtype=np.uint64)) | np.uint64(1)
_END = _scan.mask_of(b".!?:;\n\r")
_JOIN = _scan.mask_of(b".,:/")
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0x9F] = True


def _unit_hashes() -> np.ndarray:
    arr = pa.array(UNITS)
    buf, offs = _scan.buffers(arr)
    return np.sort(_scan.hash_spans(buf, offs[:-1], offs[1:]))


_UNIT_HASHES = _unit_hashes()


class Template:
    """Template tokens of many texts: ``token`` hash, ``value`` hash, ``slot`` (is a placeholder), byte ``start``/``end``, row offsets ``at``."""

    def __init__(self, arr: pa.Array):
        buf, offs = _scan.buffers(arr)
        s, e, h, rows = _scan.words(buf, offs, _scan.SPACE_PUNCT)
        n = len(s)
        pad = np.concatenate((buf, np.zeros(2, np.uint8)))
        b0, b1 = pad[s], pad[s + 1] if n else pad[:0]
        num = (b0 >= 48) & (b0 <= 57)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
        follows = np.zeros(n, bool)
        follows[1:] = row[1:] == row[:-1]
        gap = np.zeros(n, np.int64)
        gap[1:] = s[1:] - e[:-1]
        # 3.14, 1,000 and 2020/21 are one number: later parts are dropped
        part = np.zeros(n, bool)
        part[1:] = num[1:] & num[:-1] & follows[1:] & (gap[1:] == 1) & _JOIN[buf[s[1:] - 1]]
        value = np.where(num, _scan.mix(h), h)  # as of a number of one part
        if part.any():
            group = np.cumsum(~part) - 1
            value = np.zeros(int(group[-1]) + 1, np.uint64)
            np.add.at(value, group, _scan.mix(h + (np.arange(n) - np.flatnonzero(~part)[group]).astype(np.uint64)))
            keep = np.flatnonzero(~part)
            last = np.append(keep[1:], n) - 1
            s, e, h, num, row, b0, b1 = s[keep], e[last], h[keep], num[keep], row[keep], b0[keep], b1[keep]
            value = np.where(num, value, h)
            n = len(s)
            rows = np.searchsorted(row, np.arange(len(offs)))
            follows = np.zeros(n, bool)
            follows[1:] = row[1:] == row[:-1]
        ends = np.concatenate(([0], np.cumsum(_END[buf], dtype=np.int32)))
        inside = np.zeros(n, bool)
        inside[1:] = follows[1:] & (ends[s[1:]] == ends[e[:-1]])
        upper = ((b0 >= 65) & (b0 <= 90)) | ((b0 == 0xC3) & _LATIN[b1])
        cap = upper & ~((b1 >= 65) & (b1 <= 90)) & (e - s > 1)
        unit = np.zeros(n, bool)
        if n:
            at = np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)
            unit[1:] = num[:-1] & follows[1:] & (_UNIT_HASHES[at] == h)[1:]
        name = cap & inside & ~unit
        self.capital, self.start, self.end, self.at, self.value = cap, s, e, rows, value
        self.token = np.select([num, unit, name], [np.uint64(_NUM), np.uint64(_UNIT), np.uint64(_NAME)], h)
        self.slot = num | unit | name

    def windows(self, length: int = WINDOW) -> np.ndarray:
        """Hash of the window of ``length`` tokens that begins at each token; windows may run past a row's end."""
        out = np.zeros(len(self.token), np.uint64)
        m = len(out) - length + 1
        if m > 0:
            out[:m] = np.uint64(WINDOW - length)
            for j in range(length):
                out[:m] += self.token[j : m + j] * _COEF[j]
            out[:m] = _scan.mix(out[:m])
        return out


class Bench:
    """Windows of benchmark items, by the length of their window: that of ``WINDOW`` tokens, or of a short item's own.

    Items that differ in nothing but the values under their placeholders are one class: they
    have one template, one entry in the tables and one alignment.  Only how many values differ
    is counted for each member.
    """

    def __init__(self, items: list, texts: list):
        every = Template(pa.array(texts, pa.string()))
        classes: dict[tuple, list[int]] = {}
        for i, (a, z) in enumerate(zip(every.at.tolist(), every.at[1:].tolist())):
            slot, value = every.slot[a:z], every.value[a:z]
            own = value[slot]
            exact = z - a < WINDOW and int((~slot).sum()) < PLAIN_WORDS
            _, at, which = np.unique(own, return_index=True, return_inverse=True)
            same = own if exact else at[which]  # which placeholders have one value
            classes.setdefault((every.token[a:z].tobytes(), bool(every.capital[a:z][:1].any()), exact, same.tobytes()), []).append(i)
        self.items, self.members = items, list(classes.values())
        cut = lambda x: [x[a:z] for a, z in zip(every.at, every.at[1:])]
        slots, values = cut(every.slot), cut(every.value)
        self.values = [np.stack([values[i][slots[i]] for i in m]) for m in self.members]  # under the placeholders, by member
        t = Template(pa.array([texts[m[0]] for m in self.members], pa.string()))
        n = np.diff(t.at)
        self.length = np.minimum(n, WINDOW)
        self.total = np.maximum(n - WINDOW + 1, 1)
        cut = lambda x: [x[a:z] for a, z in zip(t.at, t.at[1:])]
        self.value, self.slot = cut(t.value), cut(t.slot)
        self.exact = [k[2] for k in classes]
        item = np.repeat(np.arange(len(self.members)), n)
        pos = np.arange(len(item)) - t.at[:-1][item] if len(item) else item
        self.tables = {}
        for length in np.unique(self.length[n > 0]).tolist():
            ok = (self.length[item] == length) & (pos + length <= n[item])
            parts = [(t.windows(length)[ok], item[ok], pos[ok])]
            first = np.flatnonzero(ok & (pos == 0) & t.capital)  # in the middle of a sentence its first word reads as a name
            if len(first):
                token = np.stack([t.token[first + j] for j in range(length)], 1)
                token[:, 0] = _NAME
                h = (token * _COEF[:length]).sum(1, dtype=np.uint64) + np.uint64(WINDOW - length)
                parts.append((_scan.mix(h), item[first], pos[first]))
            h, i, q = (np.concatenate([x[k] for x in parts]) for k in range(3))
            order = np.argsort(h, kind="stable")
            self.tables[length] = h[order], i[order], q[order]

    @cached_property
    def seen(self) -> dict[int, np.ndarray]:
        """Low bits of the hashes of each table (made where it is used)."""
        out = {}
        for length, (h, _, _) in self.tables.items():
            out[length] = np.zeros(1 << 20, bool)
            out[length][(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    def hits(self, length: int, w: np.ndarray) -> np.ndarray:
        """Positions of ``w`` whose window is in the benchmark."""
        table = self.tables[length][0]
        at = np.flatnonzero(self.seen[length][(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(table, w[at]), len(table) - 1)
        return at[table[k] == w[at]]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., n[0] numbers each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _match(bench: Bench, length: int, t: Template, lo: int, hi: int, hit: np.ndarray, w: np.ndarray, first: bool) -> list[tuple]:
    """Items found in the row of tokens lo..hi by its windows at ``hit``: (item, windows, cover, slots, changed, first token, end token); the ``first`` one may be enough."""
    h, item, pos = bench.tables[length]
    kinds, kind = np.unique(w[hit], return_inverse=True)  # a window that a row repeats is looked up once
    a = np.searchsorted(h, kinds, "left")
    n = np.searchsorted(h, kinds, "right") - a
    post, which = _ranges(a, n), np.repeat(np.arange(len(kinds)), n)
    near = np.unique(np.stack([item[post], pos[post]], 1), axis=0)[:, 0]
    items, windows = np.unique(near, return_counts=True)
    by_kind = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[by_kind], np.arange(len(kinds) + 1))
    by_item = np.argsort(item[post], kind="stable")
    post, which = post[by_item], which[by_item]
    out = []
    for i in items[windows >= COVER * bench.total[items] - 1e-9].tolist():
        mine = slice(*np.searchsorted(item[post], [i, i + 1]))
        q, k = pos[post[mine]], which[mine]
        times = ends[k + 1] - ends[k]
        p, q = hit[by_kind[_ranges(ends[k], times)]], np.repeat(q, times)
        found = _aligned(bench, i, length, t, p, q)
        if found is not None:
            n, cover, slots, met, start, last = found
            changed = np.zeros(bench.values[i].shape, bool)
            for under, y in met:
                changed |= under & (bench.values[i] != y)
            out += [(m, n, cover, slots, c, start, min(last + length, hi)) for m, c in zip(bench.members[i], changed.sum(1).tolist())]
            if first:
                break
    return out


def _aligned(bench: Bench, i: int, length: int, t: Template, p: np.ndarray, q: np.ndarray) -> tuple | None:
    """(windows, cover, slots, values met, first token, last window) of class i, from windows p of the document that are its windows q.

    Along one alignment (p - q) the values under the placeholders of the windows met must map one to one.
    """
    total, slot, value = int(bench.total[i]), bench.slot[i], bench.value[i]
    at = np.flatnonzero(slot)
    same = value[at][:, None] == value[at][None]
    lines, line = np.unique(p - q, return_inverse=True)
    covered, seen, values, first, last = np.zeros(total, bool), np.zeros(len(slot), bool), {}, None, None
    order = np.argsort(line, kind="stable")
    ends = np.searchsorted(line[order], np.arange(len(lines) + 1))
    step = max(1, (1 << 20) // max(len(at) ** 2, total, len(slot), 1))
    for x in range(0, len(lines), step):
        some = order[ends[x] : ends[min(x + step, len(lines))]]
        met = np.zeros((min(step, len(lines) - x), total), bool)  # windows met, by alignment
        met[line[some] - x, q[some]] = True
        under = np.zeros((len(met), len(slot)), bool)  # tokens under them
        for j in range(min(length, len(slot))):
            under[:, j : j + total] |= met
        has = under[:, at]
        y = t.value[np.where(has, lines[x : x + len(met), None] + at[None], 0)] if len(at) else np.zeros((len(met), 0), np.uint64)
        clash = (y[:, :, None] == y[:, None, :]) != same[None]
        bad = np.zeros_like(under)
        bad[:, at] = has & (clash & has[:, None, :]).any(2)
        if bench.exact[i]:
            bad[:, at] |= has & (y != value[at][None])
        wrong = np.zeros_like(met)
        for j in range(min(length, len(slot))):
            wrong |= bad[:, j : j + total]
        good = met & ~wrong
        if not good.any():
            continue
        covered |= good.any(0)
        inside = np.zeros_like(under)
        for j in range(min(length, len(slot))):
            inside[:, j : j + total] |= good
        seen |= inside.any(0) & slot
        for k in np.flatnonzero(good.any(1)).tolist():  # an alignment whose values were met before says nothing new
            values.setdefault((inside[k, at].tobytes(), y[k].tobytes()), (inside[k, at], y[k]))
        row, col = np.nonzero(good)
        where = lines[x + row] + col
        first = int(where.min()) if first is None else min(first, int(where.min()))
        last = int(where.max()) if last is None else max(last, int(where.max()))
    n = int(covered.sum())
    return (n, n / total, int(seen.sum()), list(values.values()), first, last) if n and n >= COVER * total - 1e-9 else None


def _found(bench: Bench, arr: pa.Array, first: bool = False) -> list[tuple]:
    """(row, item, ...) of every item that a text holds; with ``first`` some of them, where there is any."""
    t, out = Template(arr), []
    row_of = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))
    for length in bench.tables:
        w = t.windows(length)
        hit = bench.hits(length, w)
        hit = hit[hit + length <= t.at[1:][row_of[hit]]]
        if length == 1:  # a word alone is an item only where there is nothing else
            hit = hit[np.diff(t.at)[row_of[hit]] == 1]
        rows, cut = np.unique(row_of[hit], return_index=True)
        for r, a, z in zip(rows.tolist(), cut, [*cut[1:], len(hit)]):
            out += [(r, i, *x) for i, *x in _match(bench, length, t, int(t.at[r]), int(t.at[r + 1]), hit[a:z], w, first)]
    return sorted(out)


def _scan_docs(bench: Bench):
    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                rows = _found(bench, part.column(1))
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array([x[0] for x in rows], pa.int64())),
                        pa.array([bench.items[x[1]] for x in rows], pa.int64()),
                        pa.array([x[2] for x in rows], pa.int64()),
                        pa.array([round(x[3], 6) for x in rows], pa.float64()),
                        pa.array([x[4] for x in rows], pa.int64()),
                        pa.array([x[5] for x in rows], pa.int64()),
                    ],
                    ["doc_id", "item_id", "n_windows", "coverage", "n_slots", "n_changed"],
                )

    return run


def _without(bench: Bench):
    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in _found(bench, part.column(part.schema.get_field_index("text")), True)]] = False
                yield part.filter(pa.array(keep))

    return run


def _passes(benchmark: DataFrame):
    """The benchmark in parts of at most about PASS_WINDOWS windows; never more than one at a time is on the driver."""
    items, texts, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        items.append(r[0])
        texts.append(r[1] or "")
        held += len(texts[-1]) // 2 + 1
        if held > PASS_WINDOWS:
            yield Bench(items, texts)
            items, texts, held = [], [], 0
    if items:
        yield Bench(items, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, n_windows, coverage, n_slots, n_changed``.

    ``coverage`` is the part of the item's windows found with consistent slots (0.8 at
    least); ``n_changed`` counts placeholders with another value than the item's, so that
    it is 0 for a verbatim copy.  Null and empty texts hold nothing; items without a token
    are in no document.  Items of two to four tokens are found by a window of their length,
    with equal values if fewer than three plain words are among them; an item of one word is
    only in a document of that word alone.  Repeated rows are each answered; item ids are
    integers and may be null; repeated items are each found; other columns aren't read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([base.schema["doc_id"], *T._parse_datatype_string("item_id long, n_windows long, coverage double, n_slots long, n_changed long").fields])
    schema.fields[0].nullable = True
    out = None
    for bench in _passes(benchmark):
        found = base.mapInArrow(_scan_docs(bench), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``text`` holds no benchmark item, with all their columns.

    Each row is judged by its own text, in place: rows without an id, repeated ids and
    repeated rows are no matter, and nothing is shuffled.
    """
    for bench in _passes(benchmark):
        docs = docs.mapInArrow(_without(bench), docs.schema)
    return docs


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
