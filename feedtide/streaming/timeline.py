"""Live timelines, kept up to date by what changes on either side.

A timeline row is a subscription meeting an item of its feed. A micro-batch brings new subscriptions, new items, or
both, and adds exactly the rows that they make:

    new subscriptions x items known before,  and  all subscriptions x new items.

What is known before is kept in two tables cut into hash slots of the feed, and a batch opens only the slots of the feeds
it brings, so it reads what grows with the change, not with the history. Its rows are appended to the view, which is cut
into hash slots of the user; parts are folded when they are many (``sinks.commits``).

A batch is committed to the view first and to the two tables after it, each once whatever is tried again, so a batch that
fails in between is finished by its next attempt and no row is made twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedtide.operators.timeline import user_items
from feedtide.schemas import FEED_ITEMS, FEED_URIS
from feedtide.session import staged
from feedtide.sinks import commits

TABLES = ("subscriptions", "items")


def _known(spark: SparkSession, path: str, like: DataFrame, slots: list[int]) -> DataFrame:
    """Earlier rows of the feeds of some slots."""
    if not commits.version(spark, path).number:
        return like.limit(0)
    return commits.read(spark, path).where(F.col(commits.SLOT).isin(slots)).select(*like.columns)


def add_changes(subscriptions: DataFrame, items: DataFrame, path: str, mark: tuple[str, int]) -> None:
    """Bring the timelines at ``path`` up to date with new subscriptions and new items, once for each ``mark``."""
    spark = subscriptions.sparkSession
    new = {
        "subscriptions": staged(subscriptions.where("uri is not null"), "new-subscriptions"),
        "items": staged(items.where("dateTime is not null and feed_uri is not null"), "new-items"),
    }
    by_feed = {"subscriptions": commits.slot("uri"), "items": commits.slot("feed_uri")}
    view = f"{path}/view"
    if not commits.taken_in(spark, view, mark):
        touched = {n: [r[0] for r in new[n].select(by_feed[n]).distinct().collect()] for n in TABLES}  # a bounded number of slots
        old_items = _known(spark, f"{path}/items", new["items"], touched["subscriptions"])
        old_subscriptions = _known(spark, f"{path}/subscriptions", new["subscriptions"], touched["items"])
        made = user_items(new["subscriptions"], old_items).unionByName(
            user_items(old_subscriptions.unionByName(new["subscriptions"]), new["items"])
        )
        cut = made.withColumn(commits.SLOT, commits.slot("user_id"))
        commits.append(cut.repartition(commits.SLOT, F.xxhash64("uri") % 8), view, mark)
    for name in TABLES:
        commits.append(new[name].withColumn(commits.SLOT, by_feed[name]), f"{path}/{name}", mark)


def start_live_timelines(
    spark: SparkSession, subscriptions_path: str, items_path: str, path: str, checkpoint: str
) -> StreamingQuery:
    """Take in what has come to the folders of subscriptions and items, then stop. Timelines and their state are at ``path``."""

    def side(schema, folder: str, is_item: bool) -> DataFrame:
        columns = [F.col(c).alias(f"{'item' if is_item else 'sub'}_{c}") for c in schema.names]
        return spark.readStream.schema(schema).parquet(folder).select(F.lit(is_item).alias("is_item"), *columns)

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = staged(batch, "timeline-changes")
        pick = lambda schema, prefix: [F.col(f"{prefix}_{c}").alias(c) for c in schema.names]
        subscriptions = rows.where("not is_item").select(*pick(FEED_URIS, "sub"))
        add_changes(subscriptions, rows.where("is_item").select(*pick(FEED_ITEMS, "item")), path, (checkpoint, batch_id))

    changes = side(FEED_URIS, subscriptions_path, False).unionByName(side(FEED_ITEMS, items_path, True), allowMissingColumns=True)
    return (
        changes.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_timelines(spark: SparkSession, path: str, user: str | None = None) -> DataFrame:
    """(user_id, feed_uri, item_type, title, uri, dateTime) of all users, or of one, whose slot alone is read."""
    rows = commits.read(spark, f"{path}/view")
    if user is not None:
        rows = rows.where((F.col(commits.SLOT) == commits.slot(F.lit(user))) & (F.col("user_id") == user))
    return rows.drop(commits.SLOT)
