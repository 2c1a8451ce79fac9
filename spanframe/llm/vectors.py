"""Vector columns: which rows can be compared, and Arrow lists as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where a vector is there and all its components are finite numbers; never null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def not_zero(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def matrices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their vectors) for each length among the lists of a column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    marks = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), np.int64))])
    sizes = np.diff(marks)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[marks[rows][:, None] + np.arange(size)]
