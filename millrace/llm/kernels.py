"""Array kernels over the bytes of whole Arrow batches: words, hashes, windows.

A batch's texts lie in one buffer, so a kernel handles thousands of documents
without a Python step for each.  Buffers are taken in slices of whole documents
of about SLICE bytes, which keeps temporaries in the processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(0xC2B2AE3D27D4EB4F | 1)


def _prefix(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal bytes have equal hashes anywhere."""
    sums, down = _prefix(_BYTE_CODE[data], _BYTES)
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; one for each start, the caller drops those over an end."""
    if len(words) < k:
        return np.empty(0, U64)
    sums, down = _prefix(mix(words), _WORDS)
    n = len(words) - k + 1
    return mix((sums[k:] - sums[:n]) * down[:n])


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = int(offsets[-1])
    data = np.frombuffer(data, np.uint8, size) if data is not None and size else np.empty(0, np.uint8)
    return data[offsets[0]:], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, bytes, offsets from 0) of runs of whole documents."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than 0x20 and 0x09-0x0D, and the index of
    each document's first word (one more entry for the end)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:n])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | first[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(stop)
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the index of each document's first."""
    s, e, first = word_spans(data, offsets)
    return span_hashes(data, s, e), first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    done = 1
    while done * 2 <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    if done < w:
        x = np.minimum(x[:len(x) - (w - done)], x[w - done:])
    return x


def repeat_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(total)


def packed(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-width values that lie in a binary column, end to end, and their offsets."""
    data, offsets = texts(column)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(np.ascontiguousarray(data), dtype), offsets // width


def pack(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from values end to end; the reverse of packed()."""
    width = values.dtype.itemsize
    raw = pa.py_buffer(np.ascontiguousarray(values))
    ends = pa.py_buffer((offsets * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, raw])
