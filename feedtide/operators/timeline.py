"""Per-user timelines of feed items, joined with votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedtide.operators.skew import attach_per_key, salted_join
from feedtide.operators.votes import one_vote_per_key
from feedtide.session import staged
from feedtide.sinks import zones


def untimed_items(items: DataFrame) -> DataFrame:
    """Items without a time; they have no place in a timeline."""
    return items.where(F.col("dateTime").isNull())


def _subscriptions(feed_uris: DataFrame) -> DataFrame:
    return feed_uris.where("uri is not null").select("user_id", "feed_id", F.col("uri").alias("feed_uri"))


def _per_feed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feed_uri").agg(F.count(F.lit(1)).alias("n_rows"))


def user_items(feed_uris: DataFrame, items: DataFrame, min_hot_rows: int | None = None) -> DataFrame:
    """(user_id, feed_uri, item_type, title, uri, dateTime): items of every subscription.

    A feed subscribed twice by a user shows its items twice, as two subscriptions
    do in the reader. Feeds with very many items or subscribers are salted on
    that side. ``items`` is counted and read, so parsed feeds are best staged.
    """
    subscriptions = _subscriptions(feed_uris)
    timed = items.where(F.col("dateTime").isNotNull())
    joined = salted_join(
        timed,
        subscriptions,
        ["feed_uri"],
        [F.col("uri"), F.col("dateTime")],
        _per_feed(timed),
        "n_rows",
        right_spread=[F.col("user_id"), F.col("feed_id")],
        right_sizes=_per_feed(subscriptions),
        min_rows=min_hot_rows,
    )
    return joined.select("user_id", "feed_uri", "item_type", "title", "uri", "dateTime")


def timeline(rows: DataFrame) -> DataFrame:
    """Each user's items, newest first. The sort range-partitions by all keys, so long timelines split."""
    return rows.orderBy("user_id", F.desc("dateTime"), "uri", "feed_uri")


def timeline_page(
    feed_uris: DataFrame, items: DataFrame, size: int, min_hot_rows: int | None = None
) -> DataFrame:
    """The ``size`` newest items of each user, with their rank.

    A page takes at most ``size`` items from any one feed, so feeds are cut to
    their newest ``size`` before they meet their subscribers. Spark applies both
    rank limits within each input partition first, so neither a long feed nor a
    user of many feeds lands on one task whole.
    """
    newest_in_feed = Window.partitionBy("feed_uri").orderBy(F.desc("dateTime"), "uri")
    newest_for_user = Window.partitionBy("user_id").orderBy(F.desc("dateTime"), "uri", "feed_uri")
    heads = (
        items.where(F.col("dateTime").isNotNull())
        .withColumn("_place", F.row_number().over(newest_in_feed))
        .where(F.col("_place") <= size)
        .drop("_place")
    )
    subscriptions = _subscriptions(feed_uris)
    joined = salted_join(
        subscriptions,
        heads,
        ["feed_uri"],
        [F.col("user_id"), F.col("feed_id")],
        _per_feed(subscriptions),
        "n_rows",
        min_rows=min_hot_rows,
    )
    return (
        joined.select("user_id", "feed_uri", "item_type", "title", "uri", "dateTime")
        .withColumn("rank", F.row_number().over(newest_for_user))
        .where(F.col("rank") <= size)
    )


def oldest_items(feed_uris: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, _oldest): the oldest item time of every user's timeline.

    It is the oldest of their feeds' oldest items, so the timeline itself need not be built.
    """
    first_times = items.groupBy("feed_uri").agg(F.min("dateTime").alias("_first"))
    subscriptions = feed_uris.select("user_id", F.col("uri").alias("feed_uri")).distinct()
    return subscriptions.join(first_times, "feed_uri").groupBy("user_id").agg(F.min("_first").alias("_oldest"))


def _not_before(votes: DataFrame, oldest: DataFrame, min_hot_rows: int | None) -> DataFrame:
    sizes = votes.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n_votes"))
    return (
        attach_per_key(votes, oldest.join(sizes, "user_id"), ["user_id"], "_n_votes", min_hot_rows)
        .where(F.col("uriCreatedAt") >= F.col("_oldest"))
        .select(*votes.columns)
    )


def votes_since_oldest_item(
    feed_uris: DataFrame, items: DataFrame, votes: DataFrame, min_hot_rows: int | None = None
) -> DataFrame:
    """Votes whose item is not older than the oldest item of the user's timeline."""
    return _not_before(votes, oldest_items(feed_uris, items), min_hot_rows)


def stored_votes_since_oldest_item(
    feed_uris: DataFrame, items: DataFrame, path: str, min_hot_rows: int | None = None
) -> DataFrame:
    """``votes_since_oldest_item`` of a table written by ``sinks.zones``: parts that are too old are not opened."""
    spark = feed_uris.sparkSession
    oldest = staged(oldest_items(feed_uris, items), "oldest-items")
    return _not_before(zones.since(spark, path, oldest, "_oldest"), oldest, min_hot_rows)


def with_votes(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """Add ``state`` and ``doc_id`` of the user's vote on exactly this item and time.

    No vote is state 0 and no doc_id. Times are compared as timestamps, to the
    microsecond. The key holds the user, so a popular item spreads over its readers.
    """
    reduced = one_vote_per_key(votes).select(
        "user_id", "uri", F.col("uriCreatedAt").alias("dateTime"), "doc_id", F.col("state").alias("_state"),
        F.col("title").alias("_title"),
    )
    return rows.join(reduced, ["user_id", "uri", "dateTime"], "left").select(
        *[c for c in rows.columns if c != "title"],
        F.coalesce("_title", "title").alias("title"),
        F.coalesce("_state", F.lit(0)).alias("state"),
        "doc_id",
    )
