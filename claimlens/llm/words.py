"""Word tables of Arrow text columns, built with numpy inside tasks.

A text column is cut into runs of rows of about ``RUN_BYTES``; for each run the words of all rows come as arrays
(row, byte range, 64-bit hash). Memory is bounded by the run or by one text, whichever is larger. Hashes are
64-bit polynomial hashes; two different words share one with a chance of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_BLOCK = 1 << 17
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, a-z and all of non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = _powers(_STEP, 2 * _BLOCK)
    down = _powers(_STEP_INVERSE, 2 * _BLOCK)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(cls.up):
            return cls.up, cls.down
        return _powers(_STEP, n), _powers(_STEP_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per ascending, non-overlapping byte range."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        size = int(ends[upto - 1]) - first
        up, down = _Powers.get(size + 1)
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUES[data[first : first + size]] * up[:size], out=sums[1:])
        s, e = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = (sums[e] - sums[s]) * down[s]
        at = upto
    return mix(out)


class Run(NamedTuple):
    """Words of the rows ``lo`` to ``hi`` of a column; the words of row ``lo + i`` are ``first[i]:first[i + 1]``."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``member`` bytes; row ends also end a run."""
    inside = member[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    begin[offsets[full]] = inside[offsets[full]]
    last[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def row_runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def runs(column: pa.Array, member: np.ndarray = SPACED, lower: bool = True, size: int = RUN_BYTES) -> Iterator[Run]:
    """The words of a text column, run by run, every row in exactly one run."""
    data, offsets = raw(column)
    for lo, hi in row_runs(offsets, size):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if lower:
            part = LOWER[part]
        starts, ends = spans(part, at, member)
        yield Run(lo, hi, part, at, starts, ends, np.searchsorted(starts, at), hash_ranges(part, starts, ends))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values (across rows too; the caller cuts)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return mix(out)


def text_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words given as text, equal to those of ``runs``; for small dictionaries."""
    raw_words = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw_words], dtype=np.int64)
    return hash_ranges(np.frombuffer(b"".join(raw_words), dtype=np.uint8), ends - [len(w) for w in raw_words], ends)


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the bytes of ``values[cuts[i]:cuts[i + 1]]``."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])
