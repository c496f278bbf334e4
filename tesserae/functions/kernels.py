"""Array kernels over Arrow string columns: a column is one buffer of code points with row bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64; those of usual sizes are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1 << 16, 1 << max(0, n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of a string column; nulls are empty."""
    if values.null_count:
        values = values.fill_null("")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    off = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def row_ranges(off: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def runs(ink: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal True runs that don't cross the row bounds `edges`."""
    if not len(ink):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    inner = edges[(edges > 0) & (edges < len(ink))]
    start[inner] = ink[inner]
    end[inner - 1] = ink[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end) of an integer array, by one running sum."""
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(values)), out=total[1:])
        h = (total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))
