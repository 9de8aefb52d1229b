"""Words and hashes of whole batches of texts, vectorised over their UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes between words: space, and tab to carriage return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_C = ctypes.CDLL(None)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are tokenised at once; it bounds the working memory.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets into them; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each piece has about ``limit`` bytes of ``column`` at most (one row at least).

    At the end the worker gives freed memory back, as it waits for other tasks.
    """
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = text_bytes(batch.column(column))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                yield batch.slice(at, to - at)
                at = to
    finally:
        release()


def release() -> None:
    """Return memory that is free but still held to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim:
        trim(0)


class Words:
    """Words of a column of texts: byte ranges, 64-bit hashes, and each text's range of words."""

    def __init__(self, col: pa.Array, lower: bool = False):
        data, offsets = text_bytes(col)
        self.data = data = _LOWER[data] if lower else data
        word = ~_IS_SEP[data]
        n = len(data)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte begins a word, whatever stands before
        begins[first] = word[first]
        ends = np.zeros(n + 1, dtype=bool)
        ends[1 : n + 1] = word
        ends[1:n] &= ~word[1:]
        ends[first] = np.where(first > 0, word[first - 1], False) if n else False
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends)
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, eight bytes at a time."""
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(lengths.astype(np.uint64) * _C3 ^ (eight[starts] & _MASKS[np.minimum(lengths, 8)]))
    live, done = np.flatnonzero(lengths > 8), 8
    while len(live):
        part = eight[starts[live] + done] & _MASKS[np.minimum(lengths[live] - done, 8)]
        h[live] = mix(h[live] * _C3 ^ part)
        done += 8
        live = live[lengths[live] > done]
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; entry i covers words i to i + k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 8:
        out = h[:n].copy()
        for j in range(1, k):
            out = out * _C3 + h[j : j + n]
        return mix(out)
    ups = np.full(len(h), _C3)
    ups[0] = 1
    np.multiply.accumulate(ups, out=ups)
    downs = np.full(n, _INVERSE)
    downs[0] = 1
    np.multiply.accumulate(downs, out=downs)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * ups, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * downs)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
