"""Arrow list columns as numpy matrices, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def plain(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col


def matrix(col) -> tuple[np.ndarray | None, np.ndarray]:
    """(n, d) doubles of a list column, and which rows are present; None when no row is."""
    arr = plain(col)
    present = ~np.asarray(arr.is_null())
    if not present.any():
        return None, present
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if present.all():
        return flat.reshape(len(arr), -1), present
    out = np.zeros((len(arr), len(flat) // int(present.sum())))
    out[present] = flat.reshape(int(present.sum()), -1)
    return out, present


def column(data, name: str) -> np.ndarray:
    return plain(data.column(name)).to_numpy(zero_copy_only=False)


def lists(mat: np.ndarray) -> pa.Array:
    """(n, d) matrix as a list<double> column."""
    n, d = mat.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)),
        pa.array(np.ascontiguousarray(mat, dtype=np.float64).reshape(-1)),
    )
