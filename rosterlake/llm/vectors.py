"""Arrays of numbers as matrices, for the operators on embeddings."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_vectors(column: pa.Array):
    """Yield (rows, matrix) for each length among the vectors that are not NULL and whose components are all finite numbers."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # a NULL component becomes NaN
    ends = np.cumsum(lengths)
    odd = np.r_[0, np.cumsum(~np.isfinite(flat))]
    good = np.asarray(pc.is_valid(column)) & (odd[ends] == odd[ends - lengths])
    for dims in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == dims))
        yield rows, flat[(ends[rows] - dims)[:, None] + np.arange(dims)]


def packed(matrix: np.ndarray, dtype: str) -> list[bytes]:
    """One byte string per row."""
    data, width = np.ascontiguousarray(matrix, dtype).tobytes(), matrix.shape[1] * np.dtype(dtype).itemsize
    return [data[i : i + width] for i in range(0, len(data), width)] if width else [b""] * len(matrix)


def unpacked(rows: list[bytes], dims: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), dims).astype(np.float64)


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    scale = np.abs(matrix).max(axis=1, keepdims=True, initial=0)
    m = matrix / np.where(scale > 0, scale, 1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)
