"""Vectorised access to the UTF-8 bytes and words of Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D; the separators are single
bytes in UTF-8, so words are found on bytes. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, end to end, and the n + 1 row offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, budget: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``budget`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = solid[begin]
    return np.flatnonzero(first)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the word offsets of the rows. ``lower`` folds A-Z only."""
    starts = word_starts(data, offsets) if len(data) else np.zeros(0, np.int64)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    out = np.empty(len(starts), np.uint64)
    table = _LOWER if lower else _BYTE
    ends = np.append(starts[1:], len(data))
    # The arrays of 8 bytes per byte of text are made for a part of the words at a time.
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 20), "right")))
        gaps = ends[a:b] - starts[a:b]
        at = np.arange(starts[a], ends[b - 1]) - np.repeat(starts[a:b], gaps)
        power = np.multiply.accumulate(np.full(int(gaps.max()), _STEP))
        out[a:b] = np.add.reduceat(table[data[starts[a]:ends[b - 1]]] * power[at], starts[a:b] - starts[a])
        a = b
    return mix(out), rows


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` symbols; the result has len(h) - k + 1 entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size, acc, done = h, 1, None, 0  # runs of 1, 2, 4, ... symbols, put together as the bits of k say
    while True:
        step = np.uint64(pow(int(_STEP), size, 1 << 64))
        if k & size:
            acc = run[:len(h) - size + 1] if acc is None else acc[:len(run) - done] * step + run[done:]
            done += size
        if done == k:
            break
        run = run[:-size] * step + run[size:]
        size *= 2
    return mix(acc)
