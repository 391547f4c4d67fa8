"""Vectors that take part, as float64 matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose id isn't null and whose vector is neither null nor zero nor holds null or non-finite parts."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def widths(rows: DataFrame, vector_col: str) -> list[tuple[int, int]]:
    """(width, rows) of all widths, the most frequent first; two numbers for each width reach the driver."""
    got = rows.groupBy(F.size(vector_col).alias("w")).count().collect()
    return sorted(((r["w"], r["count"]) for r in got), key=lambda x: (-x[1], x[0]))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a list column's rows of each width."""
    if not len(column):
        return
    size = np.diff(column.offsets.to_numpy())
    for w in np.unique(size):
        at = np.flatnonzero(size == w)
        yield at, matrix(column if len(at) == len(size) else column.take(pa.array(at)))
