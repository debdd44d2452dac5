"""Columns of vectors as arrays, for the operators that score blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of vectors of one side that a task holds at most.
SIDE_BYTES = 64 << 20


def finite(vector: str) -> Column:
    """Whether a vector is there and none of its components is null, infinite or no number."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def block_rows(most: int, dims: int) -> int:
    """Rows of a block: `most`, fewer for vectors so long that they would take over SIDE_BYTES."""
    return max(1, min(most, SIDE_BYTES // (8 * max(1, dims))))


def by_length(column: pa.ChunkedArray, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors as an array, for each length that occurs; built from the column's buffers, without Python numbers."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # without chunks
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, values[starts[rows][:, None] + np.arange(length)]
