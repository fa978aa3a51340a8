"""Table writers: append, overwrite, and the update-only score merge, whole or as a delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.functions.text import path_key
from feedtide.schemas import RSS_ITEM_COLUMNS
from feedtide.sinks import commits

TERM_COLUMNS = ("word", "uri", "tfidf", "feedUrl")
SCORE_KEY = ("feed_key", "uri_key")
TERM_COLUMNS_WITHOUT_FEED = ("word", "uri", "tfidf")


def append_items(items: DataFrame, path: str) -> None:
    """Append item rows as they are: no key, no dedup, so repeated runs repeat rows."""
    items.select(*RSS_ITEM_COLUMNS).write.mode("append").parquet(path)


def overwrite_terms(
    rows: DataFrame, path: str, columns: tuple[str, ...] = TERM_COLUMNS, older_than: float = commits.DAY
) -> None:
    """Replace the scored-term table, creating it if needed.

    A new version is written below ``path`` and then committed, so a failed run leaves the old one in place, ``rows``
    may read it, and of several writers none is lost: each has its own version, the last committed one is current.
    Versions that have not been current for ``older_than`` seconds go.
    """
    commits.replace(rows.select(*columns), path, older_than=older_than)


def read_terms(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version of a scored-term table, or an earlier one by number."""
    return commits.read(spark, path, version)


def with_path_keys(scores: DataFrame) -> DataFrame:
    """Add the path-safe ``feed_key`` and ``uri_key`` of each score."""
    return scores.withColumn("feed_key", path_key("feed_url")).withColumn("uri_key", path_key("uri"))


def one_score_per_key(scores: DataFrame) -> DataFrame:
    """(feed_key, uri_key, trend_score); of several sources with one key, the last by name wins."""
    return with_path_keys(scores).groupBy("feed_key", "uri_key").agg(
        F.max_by("trend_score", F.struct("feed_url", "uri")).alias("trend_score")
    )


def merge_scores(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """New version of ``targets``: ``trend_score`` set where a score exists, all else kept.

    Update only: scores without a target row add nothing (see ``skipped_scores``).
    """
    new = one_score_per_key(scores).withColumnRenamed("trend_score", "_new_score")
    columns = [c for c in targets.columns if c != "trend_score"]
    old = F.col("trend_score") if "trend_score" in targets.columns else F.lit(None).cast("double")
    return targets.join(new, ["feed_key", "uri_key"], "left").select(
        *columns, F.coalesce("_new_score", old).alias("trend_score")
    )


def publish_targets(targets: DataFrame, path: str) -> None:
    """Make ``targets`` the table at ``path`` that scores are merged into."""
    commits.replace(targets, path, SCORE_KEY)


def update_scores(scores: DataFrame, path: str, compact_at: float | None = 0.25) -> None:
    """Merge scores into the table at ``path``: rows whose score changes are written, as a delta, and no others.

    The result is that of ``merge_scores``. The few changed rows are found by a join and committed against the version
    that was read, so an update by another writer is never overwritten with what stood before it.
    """
    spark = scores.sparkSession
    new = one_score_per_key(scores).withColumnRenamed("trend_score", "_new_score")

    def changes(targets: DataFrame) -> DataFrame:
        columns = [c for c in targets.columns if c != "trend_score"]
        old = F.col("trend_score") if "trend_score" in targets.columns else F.lit(None).cast("double")
        met = targets.join(new, list(SCORE_KEY)).where(F.col("_new_score").isNotNull() & ~old.eqNullSafe(F.col("_new_score")))
        return met.select(*columns, F.col("_new_score").alias("trend_score"))

    commits.update(path, spark, SCORE_KEY, changes, compact_at=compact_at)


def updated_scores(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores whose target row exists."""
    return with_path_keys(scores).join(targets, ["feed_key", "uri_key"], "left_semi")


def skipped_scores(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores whose target row does not exist."""
    return with_path_keys(scores).join(targets, ["feed_key", "uri_key"], "left_anti")
