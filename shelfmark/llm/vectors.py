"""Fixed-point vectors for the operators on embeddings: which rows count, their whole numbers, and exact sums of these.

A component c becomes floor(64 * c), c as double. Rows count whose vector is there and holds neither nulls nor entries that are
not finite; entries whose whole number a double can't tell from its neighbours (64 * |c| >= limit) count as not finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64.0


def fixed_point(vectors: DataFrame, column: str = "embedding", limit: float = 2.0**52, offset: int = 0, dims: int | None = None) -> DataFrame:
    """vec_id, x (array of longs) of the rows that count; further columns of any name change nothing. dims: lengths other than this are left out, too."""
    c = F.col(f"`{column}`")
    fine = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * SCALE < limit)
    rows = vectors.where(c.isNotNull() & F.forall(c, fine) & ((F.size(c) > 0) if dims is None else (F.size(c) == dims)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + offset).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, all of one length, as one matrix of longs."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def exact_sum(column: str) -> Column:
    """A sum of whole numbers that can't overflow."""
    return F.sum(F.col(column).cast("decimal(20,0)"))


def list_array(values: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(values).ravel()))
