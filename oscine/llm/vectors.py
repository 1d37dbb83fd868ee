"""Vectors of an Arrow column as matrices, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in the column: the rows that hold one without null, NaN or infinite components, and these
    vectors in double precision. Null and empty vectors are in none."""
    if len(column) == 0 or pa.types.is_null(column.type):
        return
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan), np.float64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    whole = bad[ends] == bad[ends - lengths]
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == length) & whole)
        if len(rows):
            yield rows, flat[(ends[rows] - length)[:, None] + np.arange(length)]
