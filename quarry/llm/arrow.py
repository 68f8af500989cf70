"""Small helpers for functions that run over Arrow batches in Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker handles at once; a single longer text is handled alone.
SLICE_BYTES = 4_000_000


class Memo(dict):
    """A mapping that fills itself by make(key) and starts anew beyond a number of entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most that many bytes in the column, or of one row."""
    size = start = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            size, start = 0, i
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def lean(run):
    """run, after whose last batch a worker gives memory back that it keeps for later: workers wait idle while other
    stages need the executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def extended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, values)
    return batch
