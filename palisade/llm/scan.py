"""Words of many texts at once, straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts looked at together; a longer text is alone.
CHUNK = 3 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(lengths: np.ndarray, limit: int = CHUNK) -> Iterator[slice]:
    """Runs of rows of about `limit` bytes."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield slice(at, stop)
        at = stop


def joined_bytes(column: pa.Array, stop: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, `stop` after each (null: empty), and where each row ends."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    whole = pc.binary_join_element_wise(whole, pa.scalar(b"", pa.large_binary()), pa.scalar(stop, pa.large_binary()))
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets[1:] - offsets[0]


def text_chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, ends) of runs of a batch."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    for part in slices(lengths):
        own = batch.slice(part.start, part.stop - part.start)
        yield own, *joined_bytes(own[column])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the last value is false."""
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings of `length` bytes from `start`."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    return pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(offsets), pa.py_buffer(data[at])).cast(pa.string())


def number(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which, first, bytes, offsets): the number of each string between `offsets` among the distinct
    ones, a place of each of those, and these."""
    strings = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])
    coded = strings.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    own = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[:len(first) + 1]
    raw = np.frombuffer(coded.dictionary.buffers()[2] or b"", np.uint8)[:own[-1]]
    return which.astype(np.int64), first, raw, own
