"""Vectorised helpers on the UTF-8 bytes of an Arrow string column.

Every function works on one bounded slice of a batch (``slices``), so memory
follows the slice size or the longest single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pows: dict[int, np.ndarray] = {}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _powers(base: int, n: int) -> np.ndarray:
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.empty(size, U64)
        p[0] = 1
        done = 1
        while done < size:  # doubling: p[done+i] = p[i] * base**done
            m = min(done, size - done)
            p[done : done + m] = p[:m] * U64(pow(base, done, 1 << 64))
            done += m
        if size > 1 << 21:  # a rare giant text: don't keep its table
            return p
        _pows[base] = have = p
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Spans:
    """Hashes of any byte ranges of a buffer: equal bytes, equal hash, wherever they stand."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.inv = _powers(_INV, n + 1)
        self.pre = np.zeros(n + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * _powers(_BASE, n + 1)[:n], out=self.pre[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.pre[end] - self.pre[start]) * self.inv[start]
        return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))

    def rolling(self, k: int) -> np.ndarray:
        """Hash of raw[i:i+k] for each i."""
        return mix((self.pre[k:] - self.pre[:-k]) * self.inv[: len(self.pre) - k])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes without ASCII white space; runs never cross rows."""
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] = solid[edges]
    start = np.flatnonzero(begins)
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:] = solid
    stop[1:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    stop[inner] = solid[inner - 1]
    end = np.flatnonzero(stop)
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def to_i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
