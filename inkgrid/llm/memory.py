"""What a Python worker keeps between tasks.

Spark reuses workers, so tables remembered by one operator would lie beside the next one's arrays. A
task claims its worker for an operator: what other operators remember goes, and freed memory is
given back to the system at the beginning and at the end.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_drops: dict[str, Callable[[], None]] = {}
_owner = ""


def remembers(owner: str, drop: Callable[[], None]) -> None:
    """``drop`` empties what ``owner`` remembers."""
    _drops[owner] = drop


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it gives memory back as it likes
        pass


def claim(owner: str) -> None:
    global _owner
    if owner != _owner:
        for name, drop in _drops.items():
            if name != owner:
                drop()
        gc.collect()
        _owner = owner
    trim()


def task(owner: str):
    """Wraps the function of a ``mapInArrow``."""

    def wrap(run):
        def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim(owner)
            yield from run(batches)
            trim()

        return claimed

    return wrap
