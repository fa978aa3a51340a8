"""Scans over the item table and the scored-term table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_rss_items(spark, path: str) -> DataFrame:
    """The landed item table; columns are pruned by whatever reads it."""
    return spark.read.parquet(path)


def distinct_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct (title, link, feedUrl), rows without a link dropped.

    The distinct shuffles by all three columns, so a link, title or feed that
    holds a third of the rows still spreads. ``limit`` takes the first rows by
    (link, title, feedUrl), which makes the cut repeatable.
    """
    rows = items.select("title", "link", "feedUrl").where(F.col("link").isNotNull()).distinct()
    if limit is not None:
        rows = rows.orderBy("link", "title", "feedUrl").limit(limit)
    return rows


def keyed_documents(items: DataFrame) -> DataFrame:
    """Item rows keyed by document: (uri, title, feedUrl)."""
    return items.select(F.col("link").alias("uri"), "title", "feedUrl")


def scored_terms(tfidf: DataFrame) -> DataFrame:
    """Rows of the scored-term table that belong to a known feed."""
    return tfidf.where(F.col("feedUrl").isNotNull()).select("word", "uri", "tfidf", "feedUrl")
