"""Texts of Arrow batches as flat numpy bytes, and other helpers of Python workers.

A block is a run of rows of one batch. Its texts lie end to end in one byte array,
so words, lines and n-grams of many documents are found by a few array operations.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Text bytes handled at a time. A longer text is a block of its own.
BLOCK_BYTES = 2 << 20

#: The ASCII white space characters.
WHITE = b"\t\n\x0b\x0c\r "
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
NOT_WHITE = ~IS_WHITE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Block:
    """Texts ``data[first[i]:first[i + 1]]`` of the rows of ``batch``; a null text is empty."""

    batch: pa.RecordBatch
    data: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.first[row] : self.first[row + 1]].tobytes()


def blocks(batches, column: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of about ``size`` text bytes, in order, losing no row."""
    for batch in batches:
        values = batch.column(column)
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if values.null_count:
            values = values.fill_null("")
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        _, ends, data = values.buffers()
        n = len(values)
        if not n:
            continue
        width = np.int64 if wide else np.int32
        first = np.frombuffer(ends, width)[values.offset : values.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            stop = max(row + 1, int(np.searchsorted(first, first[row] + size, "right")) - 1)
            stop = min(stop, n)
            lo, hi = first[row], first[stop]
            yield Block(batch.slice(row, stop - row), raw[lo:hi], first[row : stop + 1] - lo)
            row = stop
    # A worker serves many tasks; what Arrow holds in reserve is memory of the executor.
    pa.default_memory_pool().release_unused()


def runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a border in ``first``."""
    n = len(inside)
    edges = first[(first > 0) & (first < n)]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary values ``data[offsets[i]:offsets[i + 1]]``."""
    wide = len(data) >= 1 << 31
    offsets = np.ascontiguousarray(offsets, np.int64 if wide else np.int32)
    return pa.Array.from_buffers(
        pa.large_binary() if wide else pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))],
    )


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal for equal values, and the values by number."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def words(block: Block, inside: np.ndarray, lower: bool = False):
    """Starts and ends of the words of a block, their number codes and the coded words.

    ``inside`` tells of each byte value whether it belongs to words.
    """
    data = LOWER[block.data] if lower else block.data
    kept = inside[data]
    starts, ends = runs(kept, block.first)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    codes, known = numbered(binary_array(data[kept], offsets))
    return starts, ends, codes, known


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def worker_cache(name: str, version, make):
    """An object that lives as long as the Python worker, shared by its tasks.

    There is one of each name; another version replaces it, so workers that serve many
    queries don't gather the objects of all of them. Code is sent by value, so its own
    module level would not outlive a task.
    """
    home = sys.modules.setdefault("_burstlens_worker", types.ModuleType("_burstlens_worker"))
    if getattr(home, name, (None, None))[0] != version:
        setattr(home, name, (None, None))  # let go of the old one first
        setattr(home, name, (version, make()))
    return getattr(home, name)[1]
