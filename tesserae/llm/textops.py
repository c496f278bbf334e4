"""Vectorised text kernels over Arrow string columns.

A column is handled as one byte buffer with row offsets.  Words are maximal
runs of bytes other than space and \\t \\n \\v \\f \\r; hashes are 64-bit
polynomial hashes taken from one running sum, so a hash of any slice costs two
lookups.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: U64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:n]


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string column; nulls are empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if pa.types.is_null(values.type):
        values = values.cast(pa.string())
    if values.null_count:
        values = values.fill_null("")
    wide = pa.types.is_large_string(values.type)
    raw = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32) if len(values) else np.zeros(1, np.int32)
    off = raw[values.offset : values.offset + len(values) + 1].astype(np.int64)
    body = values.buffers()[2] if len(values) else None
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(data: np.ndarray, off: np.ndarray, most: int = 1 << 21, most_rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most `most` bytes and `most_rows` rows, or of one row: (first, last, bytes, offsets)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), i + most_rows)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; running(d)[e] - running(d)[s] belongs to d[s:e]."""
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(32))
        h = h * U64(0xD6E8FEB86659FD93)
        h = h ^ (h >> U64(32))
        h = h * U64(0xD6E8FEB86659FD93)
        return h ^ (h >> U64(32))


def hash_slices(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end) of the bytes under `run`."""
    inv = _powers(_BASE_INV, len(run))
    with np.errstate(over="ignore"):
        return mix((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (rows + 1 values)."""
    ink = ~SPACE[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    edge = off[:-1][off[:-1] < n]
    start[edge] = ink[edge]
    last = off[1:] - 1
    last = last[(last >= 0) & (off[1:] > off[:-1])]
    end[last] = ink[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def sums(values: np.ndarray, first: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; 0 for an empty range."""
    run = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=run[1:], dtype=dtype)
    return run[first[1:]] - run[first[:-1]]


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, given each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices' bytes one after the other, and their offsets."""
    size = ends - starts
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    index = np.arange(off[-1]) + np.repeat(starts - off[:-1], size)
    return data[index], off


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    bits = max(16, int(len(twice)).bit_length() + 4)
    table = np.zeros(1 << bits, bool)
    table[(twice & U64((1 << bits) - 1)).astype(np.int64)] = True
    out = table[(keys & U64((1 << bits) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    where = np.minimum(np.searchsorted(twice, keys[at]), len(twice) - 1)
    out[at] = twice[where] == keys[at]
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes as code points (uint32)."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def lookup(keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `probe` in the sorted `keys`, and whether each is there."""
    if not len(keys):
        return np.zeros(len(probe), np.int64), np.zeros(len(probe), bool)
    at = np.searchsorted(keys, probe)
    at[at == len(keys)] = 0
    return at, keys[at] == probe


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every slice [start, end) of `data`, all slices at once.

    Slices advance together: 32-byte stripes, then 8-byte lanes, a 4-byte lane
    and single bytes, each step on those that still have such a part.
    """
    n = len(starts)
    out = np.empty(n, U64)
    if not n:
        return out
    with np.errstate(over="ignore"):
        seed = U64(seed)
        size = (ends - starts).astype(np.int64)
        pad = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(pad, (len(data) + 1, 8), (1, 1))
        four = np.lib.stride_tricks.as_strided(pad, (len(data) + 1, 4), (1, 1))

        def lane(at: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(eight[at]).view("<u8").ravel()

        def rnd(acc, x):
            return _rotl(acc + x * _P2, 31) * _P1

        h = np.full(n, seed + _P5, U64)
        pos = starts.astype(np.int64).copy()
        big = np.flatnonzero(size >= 32)
        if len(big):
            at, left = pos[big], size[big] >> 5
            acc = [np.full(len(big), x, U64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            live = np.arange(len(big))
            step = 0
            while len(live):
                for k in range(4):
                    acc[k][live] = rnd(acc[k][live], lane(at[live] + 32 * step + 8 * k))
                step += 1
                live = live[left[live] > step]
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                v = (v ^ rnd(U64(0), a)) * _P1 + _P4
            h[big] = v
            pos[big] += left << 5
        h += size.astype(U64)
        rest = starts + size - pos
        live = np.flatnonzero(rest >= 8)
        while len(live):
            p = pos[live]
            h[live] = _rotl(h[live] ^ rnd(U64(0), lane(p)), 27) * _P1 + _P4
            pos[live] = p + 8
            rest[live] -= 8
            live = live[rest[live] >= 8]
        live = np.flatnonzero(rest >= 4)
        if len(live):
            p = pos[live]
            x = np.ascontiguousarray(four[p]).view("<u4").ravel().astype(U64)
            h[live] = _rotl(h[live] ^ (x * _P1), 23) * _P2 + _P3
            pos[live] = p + 4
            rest[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(rest > 0)
            if not len(live):
                break
            p = pos[live]
            h[live] = _rotl(h[live] ^ (pad[p].astype(U64) * _P5), 11) * _P1
            pos[live] = p + 1
            rest[live] -= 1
        h ^= h >> U64(33)
        h *= _P2
        h ^= h >> U64(29)
        h *= _P3
        h ^= h >> U64(32)
    return h
