"""Vectors as blobs: what the embedding operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ROWS = 4096


def slices(batches, rows: int = ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def usable(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of float64) for each length of vector; without those that are null, empty or hold null or non-finite components."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    ends = np.cumsum(sizes)
    out = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        matrix = values[(ends[rows] - size)[:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(1)
        if fine.any():
            out.append((rows[fine], matrix[fine]))
    return out


def blobs(matrix: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def matrix_of(column: list[bytes], kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)
