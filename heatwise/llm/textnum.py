"""Word and shingle hashes of a whole Arrow text column, vectorised over its UTF-8 bytes.

A word is a maximal run of characters other than blank and U+0009..U+000D.  Null texts
have no words.  Work goes in slices of bounded bytes (one longer text is a slice of its
own), so memory does not depend on the batch size.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) on uint64 values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9FB21C651E98DF25)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = [mix(np.array([i + 1], dtype=_U))[0] | _U(1) for i in range(SHINGLE_WORDS)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def give_back() -> None:
    """Hand memory that Arrow and the C library keep for later back to the machine: a Python worker
    lives on for the next stages, whose own peaks would come on top."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) <= n:
        size = max(n, SLICE_BYTES)
        _cache["p"], _cache["q"] = _powers(_BASE, size), _powers(_INVERSE, size)
    if n > 8 * SLICE_BYTES:                      # do not keep tables of a single huge text
        return _cache.pop("p"), _cache.pop("q")
    return _cache["p"], _cache["q"]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offsets from 0, bytes) of consecutive row slices."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, offsets[row:end + 1] - offsets[row], data[offsets[row]:offsets[end]]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of marked bytes; no run crosses a row's edge."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run."""
    n = len(data)
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets of each row's words) of one slice."""
    if len(data) == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    starts, ends = runs(~_BLANK[data], offsets)
    return run_hashes(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets of each row's shingles).

    A row of fewer than five words has one shingle of all its words; a row of none, none.
    """
    counts = np.diff(at)
    per_row = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE_WORDS, _U)])
    n = len(hashes)
    summed = np.zeros(n, dtype=_U)
    for i, factor in enumerate(_PLACE):
        summed += padded[i:i + n] * factor
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    for r in short:
        own = hashes[at[r]:at[r + 1]]
        summed[at[r]] = (own * np.array(_PLACE[:len(own)], dtype=_U)).sum() + _U(len(own))
    pick = np.arange(out_at[-1], dtype=np.int64) + np.repeat(at[:-1] - out_at[:-1], per_row)
    return mix(summed[pick]), out_at


def distinct_shingles(sh: np.ndarray, at: np.ndarray
                      ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles sorted within each row, their counts, offsets per row)."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    if not len(sh):
        return sh, np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    place = np.flatnonzero(new)
    counts = np.diff(np.append(place, len(sh)))
    return sh[place], counts, np.searchsorted(row[place], np.arange(len(at))).astype(np.int64)
