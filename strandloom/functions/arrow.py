"""Helpers for Arrow-batch functions (mapInArrow)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def ints(column: pa.Array, fill: int = 0) -> np.ndarray:
    """int64 array of an Arrow column; nulls take `fill`."""
    if column.null_count:
        column = column.fill_null(fill)
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets) of a string column without copying the text."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(column) else raw[:0], off - off[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a uint64 array."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
