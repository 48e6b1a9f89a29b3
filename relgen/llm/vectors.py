"""Vectors of array columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors): the rows with exactly ``dims`` components, none of them null or non-finite."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    if not len(rows):
        return rows, np.zeros((0, dims))
    flat = pc.list_flatten(column.take(pa.array(rows)))
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    kept = np.isfinite(values).all(axis=1)
    return rows[kept], values[kept]
