"""Incremental ingest: landed feed documents to the item table, every entry of each.

One stream parses every document once and writes accepted items and rejects to
one table, partitioned by which they are; readers of either prune the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedtide.schemas import ENTRIES, RAW_FEEDS, RSS_ITEM_COLUMNS
from feedtide.sources import feeds
from feedtide.streaming.votes import state_in_rocksdb


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Stream of landed documents."""
    return spark.readStream.schema(RAW_FEEDS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_entries(landed: DataFrame) -> DataFrame:
    """Entries of a stream of landed documents: the item columns, uri, fetched_at, reason, accepted.

    Every entry of every landed document is appended, however late it lands and
    however often it is seen: the item table has no key, and ``distinct_items``
    reduces it when it is read. So nothing is kept in state and nothing is lost.
    """
    rows = feeds.item_rows(feeds.judged_entries(landed), "uri", "fetched_at", "reason", "rejected_title")
    title = F.when(F.col("reason").isNull(), F.col("title")).otherwise(F.col("rejected_title"))
    return rows.withColumn("title", title).drop("rejected_title").withColumn("accepted", F.col("reason").isNull())


#: Columns that say when an entry was seen, not what it is.
_SEEN = ("fetched_at",)


def first_seen(entries: DataFrame) -> DataFrame:
    """A stream of entries less those that are equal to an earlier one of the same document in every byte of every column.

    Exact, and for good: there is no watermark, so a repeat is told however late it comes, and an entry that differs in any
    column (null and empty differ too) is never taken for one. Spark's keyed state holds one SHA-256 digest for each
    different entry, about 60 bytes in RocksDB before compression: 6 GB for 10^8 entries, spread over the shuffle
    partitions by the digest itself, so that a document with very many entries is not one task's.
    """
    told = F.to_json(F.struct(*[c for c in entries.columns if c not in _SEEN]), {"ignoreNullFields": "false"})
    return entries.withColumn("_entry", F.unhex(F.sha2(told, 256))).dropDuplicates(["_entry"]).drop("_entry")


def start_append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of entries to its table, processing what is there and then stopping."""
    return (
        rows.writeStream.format("parquet")
        .partitionBy("accepted")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def refresh(spark: SparkSession, landed_path: str, table_path: str, checkpoint: str, repeats: bool = True) -> None:
    """One periodic run: append what is new, then stop.

    Safe to call again after a failure: the checkpoint knows what is done. Without ``repeats``, entries seen before are
    left out (``first_seen``); a checkpoint is of one kind or the other.
    """
    rows = new_entries(landed_stream(spark, landed_path))
    with state_in_rocksdb(spark):
        query = start_append(rows if repeats else first_seen(rows), table_path, checkpoint)
    query.awaitTermination()


def ingested_items(spark: SparkSession, table_path: str) -> DataFrame:
    """Item rows of an ingested table."""
    return spark.read.schema(ENTRIES).parquet(table_path).where("accepted").select(*RSS_ITEM_COLUMNS)


def rejected_entries(spark: SparkSession, table_path: str) -> DataFrame:
    """(uri, title, reason, fetched_at) of what the item table leaves out."""
    return spark.read.schema(ENTRIES).parquet(table_path).where("not accepted").select("uri", "title", "reason", "fetched_at")
