"""Texts of an Arrow batch as flat numpy arrays: bytes, word spans, word and shingle hashes.

Everything is computed for a run of rows at once; a run is cut by bytes, so that memory is bounded by the run or by one long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
# Bytes that end a word: the white space, or anything but letters, digits and bytes of other characters.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
SIGNS = np.ones(256, bool)
SIGNS[48:58] = SIGNS[65:91] = SIGNS[97:123] = SIGNS[128:] = False


LOWER_BYTES = _LOWER


def gather_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as strings."""
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    data = buf[np.repeat(starts - off[:-1], ends - starts) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data)]).cast(pa.string())


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, size: int = RUN_BYTES):
    """(first, last) rows of runs of about ``size`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (byte positions) and each row's first word; a row's end ends a word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    ink = ~white[buf]
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


_POWERS = np.ones(1, np.uint64)
_BACK = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _BACK
    if len(_POWERS) < n:
        m = max(n, 2 * RUN_BYTES)
        p, b = np.full(m, _BASE), np.full(m, _INVERSE)
        p[0] = b[0] = 1
        p, b = np.multiply.accumulate(p), np.multiply.accumulate(b)
        if n > 2 * RUN_BYTES:
            return p, b
        _POWERS, _BACK = p, b
    return _POWERS, _BACK


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial over scrambled bytes, from running sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, back = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_PLACE = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | _U(1)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each row and each row's first; a row of fewer words has one, of all its words, a row without words none."""
    count = np.diff(first)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(many)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    row = np.repeat(np.arange(len(count)), many)
    begin = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    out = np.full(len(begin), _U(n), np.uint64)
    short = count[row] < n
    if short.any():
        out[short] += count[row][short].astype(np.uint64) * _U(0x5851F42D4C957F2D)
    end = first[1:][row]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        part = padded[begin + k]
        if k and short.any():
            part = np.where(begin + k < end, part, _U(0))
        out += part * _PLACE[k]
    return mix(out), at
