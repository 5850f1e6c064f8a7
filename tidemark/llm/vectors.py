"""Rows with vectors: which of them take part, and their batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_entries(vector: Column) -> Column:
    """Whether a vector is there, holds an entry, and all its entries are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def usable(rows: DataFrame, row_id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows whose vector has finite entries only, and its length (0: there are none).

    Vectors of another length than the commonest (of equally common ones the
    longest) take no part. Other columns, whatever their names, are left out.
    """
    kept = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v")).where(finite_entries(F.col("v")))
    first = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = first["n"] if first else 0
    return kept.where(F.size("v") == length), length


def matrix(vectors: pa.Array, length: int, kind=np.float64) -> np.ndarray:
    """The vectors of a batch, each of the given length without nulls, as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, length)
