"""Python workers outlive their tasks: what a task doesn't need, it gives back."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

# The caches that some operators keep from task to task, by module.
_CACHES = {"wordbpe": "_caches", "pieces": "_models"}


def give_back() -> None:
    """Freed memory to the system, of a worker or of the driver."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow: other operators' caches go before it, freed memory goes back to the system behind it."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module, cache in _CACHES.items():
            loaded = sys.modules.get(f"{__package__}.{module}")
            if loaded is not None and module != keep:
                getattr(loaded, cache).clear()
        yield from run(batches)
        give_back()

    return wrapped
