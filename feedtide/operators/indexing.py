"""Global row numbers without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedtide.session import checkpointed

_ROW_BITS = (1 << 33) - 1


def row_index(rows: DataFrame, by: str, name: str = "row_index") -> DataFrame:
    """Number rows 0.. in ascending order of ``by``.

    Rows are range-partitioned and sorted, then checkpointed so that the
    partitions stand still; each partition's offset is the number of rows before
    it. Only the table of partition sizes (one row per partition) is windowed.
    """
    placed = checkpointed(rows.repartitionByRange(F.col(by)).sortWithinPartitions(by)).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_offset") + F.col("_row")).alias(name)
    )
