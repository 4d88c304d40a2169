"""Arrow strings as flat numpy code-point arrays, and back, one buffer call per batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Block:
    """All code points of a batch of strings. Row i is ``cp[start[i]:start[i + 1]]``; nulls are empty."""

    cp: np.ndarray
    start: np.ndarray
    null: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row ordinal of every code point."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def to_block(col: pa.Array | pa.ChunkedArray) -> Block:
    """Decode a string column into code points without touching single strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return Block(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool))
    null = np.asarray(col.is_null())
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    lead = (raw & 0xC0) != 0x80
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=upto[1:])
    start = upto[offs - offs[0]]
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return Block(cp, start, null)


def to_strings(cp: np.ndarray, start: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Strings of the rows ``cp[start[i]:start[i + 1]]``; encodes all code points in one call."""
    cp = np.ascontiguousarray(cp, np.uint32)
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    upto = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(width, out=upto[1:])
    offs = upto[start]
    data = cp.tobytes().decode("utf-32-le").encode("utf-8")
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    out = pa.Array.from_buffers(pa.large_string(), len(start) - 1, [valid, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])
    return out.cast(pa.string())
