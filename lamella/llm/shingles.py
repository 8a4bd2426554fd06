"""Word and shingle hashes of whole texts in numpy, many texts at a time; the buffers are those of the Arrow batch.

Words are runs of bytes other than space and \\t..\\r (no UTF-8 character holds these bytes), with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .mph import mix64

#: Texts are taken together up to so many bytes, so that what is made of them stays in the processor's cache.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20_011)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to size bytes, or a single longer one."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: Bytes between words of letters and digits alone: ASCII other than letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word and where each text's words begin (one more entry than texts). between tells the bytes that part words."""
    n = len(raw)
    first = np.zeros(len(offsets), np.int64)
    none = np.zeros(0, np.int64)
    if not n:
        return none.astype(np.uint64), none, none, first
    solid = ~between[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = solid[inner]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return none.astype(np.uint64), none, none, first
    over = ~solid
    over[begin] = True
    at = np.flatnonzero(over)
    nxt = np.append(at, n)
    ends = nxt[np.searchsorted(at, starts) + 1]
    kept = np.flatnonzero(solid)
    length = ends - starts
    which = np.repeat(np.arange(len(starts)), length)
    heads = np.cumsum(length) - length
    place = np.arange(len(kept)) - heads[which]
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[raw[kept]] * powers(int(length.max()))[place], heads)
        h = mix64(h + length.astype(np.uint64) * _PLACE[15], 7)
    return h, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[list[np.ndarray]]:
    """For ranges of texts in order: the sorted distinct shingle hashes of each; fewer words than width make one shingle, no words none."""
    raw, offsets = texts_of(column)
    for lo, hi in chunks(offsets):
        h, _, _, first = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        with np.errstate(over="ignore"):
            n = len(h)
            s = np.zeros(max(0, n - width + 1), np.uint64)
            for k in range(width):
                s += h[k : k + len(s)] * _PLACE[k]
            s = mix64(s, 11)
            out = []
            for i in range(hi - lo):
                a, b = int(first[i]), int(first[i + 1])
                if b - a >= width:
                    x = np.sort(s[a : b - width + 1])
                    out.append(x[np.append(True, x[1:] != x[:-1])])
                elif b > a:
                    out.append(mix64(np.array([(h[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64), 12))
                else:
                    out.append(np.zeros(0, np.uint64))
        yield out
