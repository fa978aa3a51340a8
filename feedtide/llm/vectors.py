"""Which vectors of a table take part, and why others don't."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fault(size: int | None, largest: float) -> Column:
    """Why ``embedding`` (doubles) can't take part; null if it can. ``size`` is the length wanted, None any."""
    values = F.col("embedding")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(values.isNull(), "no vector")
        .when(~fine, "entries that are null or not finite")
        .when(F.size(values) == 0, "empty vector")
        .when(F.exists(values, lambda x: F.abs(x) > F.lit(largest)), "entries too large")
        .when(F.lit(size is not None) & (F.size(values) != F.lit(size or 0)), "another length")
    )


def doubles(vectors: DataFrame, *columns: str) -> DataFrame:
    return vectors.select("vec_id", *columns, F.col("embedding").cast("array<double>").alias("embedding"))


def common_length(rows: DataFrame, largest: float) -> int | None:
    """The commonest length of the vectors without fault, the shorter on a tie."""
    lengths = rows.where(fault(None, largest).isNull()).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "d").first()
    return first and first.d


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column of equal lengths as rows."""
    held = batch.column(batch.schema.get_field_index(column))
    return held.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
