"""Variable-length pieces of a byte buffer as Arrow arrays, without a Python loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the pieces, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[places(starts, sizes)]


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def strings(data: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Consecutive pieces of ``data`` as strings."""
    at = offsets(sizes)
    if at[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of text in one batch")
    mask = None
    if null is not None and null.any():
        mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data)), mask)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(sizes).astype(np.int32)), values)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each consecutive group."""
    running = np.concatenate([[0], np.cumsum(values)])
    at = offsets(sizes)
    return running[at[1:]] - running[at[:-1]]


def names_of(codes: np.ndarray, names: list[str]) -> pa.Array:
    """``names[code]``; null for a negative code."""
    return pa.array(names, pa.string()).take(pa.array(codes, mask=codes < 0)) if names else pa.nulls(len(codes), pa.string())
