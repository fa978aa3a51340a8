"""Landed feeds as files of any size: entries are read by several tasks, feed-level fields in a first pass.

A document in one row is one task's, whatever its size. As a file it is read by the text source with the end tag of an
entry as its line separator, so a large file is split and a record is one entry (and what stands before it). What stands
outside the entries is put together per file, without blank stretches, to a skeleton: the document less its entries, which
says whether it is a sound feed and its own address. Entries are parsed on their own, as a document of one entry, and meet
the skeleton of their file. So the parser of whole documents serves both, and rows and quarantine are the same.

Defined results: a file whose root is of the other dialect is judged as a whole by its skeleton and gives no entries. A file
with an entry that cannot be parsed is ``malformed_xml`` as a whole, as in a row; so is one that holds the end tag of an
entry inside a CDATA section or a comment. Compressed files are read whole by one task each, which is Spark's rule for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.operators.skew import attach_per_key
from feedtide.session import staged
from feedtide.sources.feeds import ATOM, RSS, feed_entries, feed_urls, item_rows, parse_feeds

# The element of an entry, and what a document of one entry has around it.
_ELEMENT = {RSS: "item", ATOM: "entry"}
_AROUND = {RSS: ("<rss><channel>", "</channel></rss>"), ATOM: ("<feed>", "</feed>")}


@dataclass(frozen=True)
class LargeFeeds:
    """``entries`` (uri, fetched_at, type, item, entry_reason) and ``files`` (uri, feedUrl, reason, n_entries), both staged."""

    entries: DataFrame
    files: DataFrame


def _records(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """(uri, fetched_at, start, n, outside, entry): one row an entry; the last of a file has none."""
    name = _ELEMENT[dialect]
    begins = rf"(?s)^(.*?)(<{name}[\s>/].*)$"
    rows = spark.read.option("lineSep", f"</{name}>").text(path).select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),  # ascends within a split
        "value",
    )
    entry = F.regexp_extract("value", begins, 2)
    return rows.select(
        "uri", "fetched_at", "start", "n",
        F.when(entry == "", F.col("value")).otherwise(F.regexp_extract("value", begins, 1)).alias("outside"),
        F.when(entry != "", F.concat(entry, F.lit(f"</{name}>"))).alias("entry"),
    )


def read(spark: SparkSession, path: str, dialect: str) -> LargeFeeds:
    """The feeds of one dialect in the files at ``path``."""
    records = _records(spark, path, dialect)
    before, after = _AROUND[dialect]
    alone = records.where("entry is not null").select(
        "uri", "fetched_at", F.concat(F.lit(before), "entry", F.lit(after)).alias("xml")
    )
    entries = staged(
        feed_entries(alone).select("uri", "fetched_at", "type", "item", F.col("reason").alias("entry_reason")), "large-feed-entries"
    )
    told = records.where(F.col("outside").rlike(r"\S")).groupBy("uri", "fetched_at").agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "outside"))).alias("parts")  # what is outside the entries
    )
    skeletons = told.select("uri", F.array_join("parts.outside", "").alias("xml"), "fetched_at")
    judged = feed_urls(parse_feeds(skeletons)).select("uri", "feedUrl", "reason", F.col("type").alias("of"))
    held = entries.groupBy("uri").agg(
        F.count(F.lit(1)).alias("n_entries"), F.max(F.col("entry_reason").isNotNull()).alias("broken")
    )
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when((F.col("of") == dialect) & F.col("broken"), "malformed_xml")
        .when(F.col("feedUrl").isNull(), "missing_feed_url")
    )
    files = judged.join(held, "uri", "left").select(
        "uri", "feedUrl", reason.alias("reason"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), (F.col("of") == dialect).alias("ours")
    )
    return LargeFeeds(entries, staged(files, "large-feed-files"))


def _met(feeds: LargeFeeds, min_hot_rows: int | None) -> DataFrame:
    """Entries of files that are sound as a whole; a file of very many entries meets its own fields map-side."""
    sound = feeds.files.where("reason is null and ours").select("uri", "feedUrl", "n_entries")
    return attach_per_key(feeds.entries, sound, ["uri"], "n_entries", min_hot_rows, stage=False)


def rss_items(feeds: LargeFeeds, min_hot_rows: int | None = None) -> DataFrame:
    """Item rows, as ``feeds.rss_items`` gives of the same documents in rows."""
    return item_rows(_met(feeds, min_hot_rows).where("item.link is not null"))


def quarantine(feeds: LargeFeeds, min_hot_rows: int | None = None) -> DataFrame:
    """(uri, title, reason), as ``feeds.quarantine``; ``uri`` is the file."""
    whole = feeds.files.where("reason is not null").select("uri", F.lit(None).cast("string").alias("title"), "reason")
    single = _met(feeds, min_hot_rows).where("item.link is null")
    return whole.unionByName(single.select("uri", F.col("item.title").alias("title"), F.lit("missing_link").alias("reason")))
