"""Words as runs of bytes, told apart exactly: each distinct word of a slice gets a number of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def runs(raw: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes that ``solid`` (256 booleans) marks; runs never cross rows."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[1:] = solid[raw]
    begins = inside[1:] & ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] = inside[1:][edges]
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:-1] = inside[1:-1] & ~inside[2:]
    ends[-1] = inside[-1]
    edges = offsets[1:][offsets[1:] > 0]
    ends[edges] |= inside[edges]
    ends[0] = False
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def numbered(raw: np.ndarray, start: np.ndarray, end: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each run's word, the distinct words as binary), told apart by their bytes."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    places = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=places[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(raw[solid[raw]])])
    told = words.dictionary_encode()
    return told.indices.to_numpy().astype(np.int64), told.dictionary
