"""What a Python worker holds, bounded by bytes, and given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is taken out of Arrow at once; a longer text stands alone.
SLICE_BYTES = 4 << 20
#: Words longer than this are worked out each time instead of remembered.
REMEMBERED_BYTES = 64

_EMPTIED: list[Callable[[], None]] = []


def emptied(clear: Callable[[], None]) -> None:
    """Have ``clear`` called at the end of every task that runs through ``slices``."""
    _EMPTIED.append(clear)


def parts(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in parts of bounded text."""
    most = SLICE_BYTES if most is None else most
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths.astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of bounded text; afterwards what the task
    remembered is dropped and its memory goes back to the machine."""
    try:
        for batch in batches:
            yield from parts(batch, column)
    finally:
        settle()


def settle() -> None:
    for clear in _EMPTIED:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only some C libraries have it
