"""Runs of bytes in Arrow columns of texts, found by whole-buffer operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is one chunk.
CHUNK = 1 << 22


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, row after the last, bytes, offsets of the rows in them: consecutive rows of at most CHUNK bytes, or one row. Null: empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cut: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes inside, ended at rows' ends and before cut, as strings in order; how many each row has.

    inside, cut: a boolean for each byte of data.
    """
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[starts] = inside[starts]
    if cut is not None:
        begins |= inside & cut
    each = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    places = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))), each


def look_up(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for a table of 256 bytes or booleans; many times as fast as by index."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)
