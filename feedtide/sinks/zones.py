"""Tables that skip files by time: cut by user bucket and time zone, with an index of what each part holds.

A part is a Parquet partition ``_bucket=b/_zone=z``: the users of one hash bucket in one stretch of time. Zones are cut
where about equally many rows lie between (approximate quantiles), so they follow the data and not the calendar. The index
is a small table beside the data with the first and last time and the rows of every part.

``since`` reads the rows that are not older than a bound per user. The bounds are reduced to the smallest of each bucket,
the index says which parts reach it, and that list, of at most ``buckets * (zones + 1)`` rows by construction, prunes the
scan before a file is opened (Spark's dynamic partition pruning). What a part holds below its users' own bounds is left to
the reader's exact filter. Rows without a time are in zone -1, which no bound reaches.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from feedtide.session import path_exists, put_if_absent, read_text, staged
from feedtide.sinks.commits import slot

BUCKET, ZONE = "_bucket", "_zone"
BUCKETS, ZONES = 16, 16


def _cuts(rows: DataFrame, time: str, zones: int) -> list[int]:
    """Where zones begin, in microseconds: ascending, at most ``zones - 1``."""
    shares = [i / zones for i in range(1, zones)]
    found = rows.select(F.percentile_approx(F.unix_micros(time), shares, 10_000)).first()[0] if shares else None
    return sorted(set(found or []))


def write_by_zone(
    rows: DataFrame,
    path: str,
    time: str,
    user: str = "user_id",
    buckets: int = BUCKETS,
    zones: int = ZONES,
    files_per_part: int = 1,
) -> None:
    """Write ``rows`` cut by bucket of ``user`` and zone of ``time``, with the index. ``path`` must be new.

    A part is dealt to ``files_per_part`` tasks by a hash of the user and the time, so a part that one user fills is still
    written by several. Take more zones, buckets or files the larger the table is.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    if path_exists(spark, path):
        raise FileExistsError(path)
    cuts = _cuts(rows, time, zones)
    at = F.unix_micros(time)
    zone = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= at)) if cuts else F.lit(0)
    placed = rows.withColumn(BUCKET, slot(user, buckets)).withColumn(ZONE, F.when(at.isNull(), -1).otherwise(zone).cast("int"))
    spread = F.pmod(F.xxhash64(user, time), F.lit(files_per_part))
    dealt = placed.repartition(BUCKET, ZONE, spread).sortWithinPartitions(BUCKET, ZONE, user, time)
    dealt.write.partitionBy(BUCKET, ZONE).parquet(f"{path}/data")
    written = _data(spark, path, rows.schema.json())
    held = written.groupBy(BUCKET, ZONE).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n_rows"))
    held.coalesce(1).write.parquet(f"{path}/index")
    said = {"user": user, "time": time, "buckets": buckets, "cuts": cuts, "schema": rows.schema.json()}
    put_if_absent(spark, f"{path}/_layout.json", json.dumps(said))


def _data(spark: SparkSession, path: str, schema: str) -> DataFrame:
    full = StructType.fromJson(json.loads(schema)).add(BUCKET, IntegerType()).add(ZONE, IntegerType())
    return spark.read.schema(full).parquet(f"{path}/data")


def _layout(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path.rstrip('/')}/_layout.json"))


def open_by_zone(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table that ``write_by_zone`` wrote."""
    said = _layout(spark, path)
    return _data(spark, path.rstrip("/"), said["schema"]).drop(BUCKET, ZONE)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(_bucket, _zone, first, last, n_rows) of every part."""
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def parts_since(spark: SparkSession, path: str, bounds: DataFrame, bound: str) -> DataFrame:
    """(_bucket, _zone) of the parts that hold a time at or after the smallest bound of their bucket's users."""
    said = _layout(spark, path)
    least = bounds.groupBy(slot(said["user"], said["buckets"]).alias(BUCKET)).agg(F.min(bound).alias("since"))
    # Stored, so that the comparison below is a filter over it, which is what lets the planner prune by it.
    met = staged(index(spark, path).join(F.broadcast(least), BUCKET), "parts")
    return met.where(F.col("last") >= F.col("since")).select(BUCKET, ZONE)


def since(spark: SparkSession, path: str, bounds: DataFrame, bound: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of the parts that ``bounds`` (user, ``bound``) reach: all that are not older than their user's bound, and some
    that are."""
    said = _layout(spark, path)
    rows = _data(spark, path.rstrip("/"), said["schema"])
    met = rows.join(F.broadcast(parts_since(spark, path, bounds, bound)), [BUCKET, ZONE], "left_semi").drop(BUCKET, ZONE)
    return met.select(*columns) if columns else met
