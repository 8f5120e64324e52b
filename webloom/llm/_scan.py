"""Vectorised scanning of Arrow string arrays: words, their spans and 64-bit hashes.

All functions work on the UTF-8 bytes of a whole Arrow array at once and never
build a Python object per word.  Memory is bounded by ``BLOCK`` bytes of text at a
time, whatever the length of one text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a block ends at a separator, so a longer word stretches it.
BLOCK = 1 << 17

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_SPACE = b" \t\n\x0b\x0c\r"
_PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def mask_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = mask_of(_SPACE)
PUNCT = mask_of(_PUNCT)
SPACE_PUNCT = SPACE | PUNCT


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64))
    if lower:
        v[65:91] = v[97:123]
    return v


LOWER, _EXACT = _byte_values(True), _byte_values(False)
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) <= n:
        size = max(BLOCK + 4096, n + 1)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        p[0] = q[0] = 1
        np.multiply.accumulate(p, out=p)
        np.multiply.accumulate(q, out=q)
        if size > 4 * BLOCK:  # one enormous word: don't keep its tables
            return p, q
        _powers["p"], _powers["q"] = p, q
    return _powers["p"], _powers["q"]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string array, and the n + 1 offsets of its rows (null rows are empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if big else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; spans ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = int(starts[0])
    b = buf[base : int(ends[-1])]
    p, q = _tables(len(b))
    cs = np.empty(len(b) + 1, np.uint64)
    cs[0] = 0
    np.cumsum((LOWER if lower else _EXACT)[b] * p[: len(b)], out=cs[1:])
    s, e = starts - base, ends - base
    return mix((cs[e] - cs[s]) * q[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _blocks(buf: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + BLOCK)
        while to < n:
            tail = np.flatnonzero(sep[buf[max(at, to - 4096) : to]])
            if len(tail):
                to = max(at, to - 4096) + int(tail[-1]) + 1
                break
            to = min(n, to + BLOCK)
        yield at, to
        at = to


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, lower: bool = True, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word, and the n + 1 word offsets of the rows.

    A word is a longest run of bytes outside ``sep`` within one row.
    """
    first = np.zeros(len(buf) + 1, bool)
    first[offs[offs < len(buf) + 1]] = True
    ss, es, hs = [], [], []
    for lo, hi in _blocks(buf, sep):
        inside = ~sep[buf[lo:hi]]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[lo + 1 : hi]
        if lo and not sep[buf[lo - 1]] and not first[lo]:
            begin[0] = False
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | first[lo + 1 : hi]
        s, e = np.flatnonzero(begin) + lo, np.flatnonzero(stop) + lo + 1
        ss.append(s)
        es.append(e)
        if hashed:
            hs.append(hash_spans(buf, s, e, lower))
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    e = np.concatenate(es) if es else np.zeros(0, np.int64)
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    return s, e, h, np.searchsorted(s, offs)


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def shapes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space word's shape (runs of lower, upper, digit or the same mark become one), and word offsets."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    c = _SHAPE[buf]
    keep = np.ones(len(c), bool)
    keep[1:] = c[1:] != c[:-1]
    keep[offs[offs < len(buf)]] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    _, _, h, rows = words(c[keep], at[offs], lower=False)
    return h, rows


def _release():
    """The C library's call that hands free memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_trim = _release()


def trim() -> None:
    """Hand back what a batch needed: workers are reused, and two stand beside each executor's heap."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; one text is never cut."""
    arr = batch.column(batch.schema.get_field_index(column))
    if not len(arr):
        return
    big = pa.types.is_large_string(arr.type)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if big else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    trim()


def code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position of one text."""
    cum = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return cum[at]
