"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType(), True) for name in names]


FEED_URIS = T.StructType(
    _strings("user_id", "feed_id", "type", "uri") + [T.StructField("timestamp", T.TimestampType(), True)]
)

RAW_FEEDS = T.StructType(_strings("uri", "xml") + [T.StructField("fetched_at", T.TimestampType(), True)])

RSS_ITEM_COLUMNS = (
    "title",
    "link",
    "pubDate",
    "creator",
    "content",
    "contentSnippet",
    "guid",
    "isoDate",
    "feedUrl",
)
RSS_ITEMS = T.StructType(_strings(*RSS_ITEM_COLUMNS))

# Ingested entries, accepted items and rejects alike; partitioned by the last column.
ENTRIES = T.StructType(
    _strings(*RSS_ITEM_COLUMNS, "uri")
    + [T.StructField("fetched_at", T.TimestampType(), True)]
    + _strings("reason")
    + [T.StructField("accepted", T.BooleanType(), True)]
)

TFIDF = T.StructType(
    _strings("word", "uri") + [T.StructField("tfidf", T.DoubleType(), True)] + _strings("feedUrl")
)

TREND_SCORE = T.StructType(
    _strings("feed_url", "uri") + [T.StructField("trend_score", T.DoubleType(), True)]
)

FEED_ITEMS = T.StructType(
    _strings("feed_uri", "item_type", "title", "uri") + [T.StructField("dateTime", T.TimestampType(), True)]
)

VOTES = T.StructType(
    _strings("user_id", "doc_id", "uri", "title")
    + [
        T.StructField("state", T.IntegerType(), True),
        T.StructField("uriCreatedAt", T.TimestampType(), True),
    ]
)

VOTE_ACTIONS = T.StructType(
    _strings("user_id", "uri", "title")
    + [T.StructField("uriCreatedAt", T.TimestampType(), True)]
    + _strings("action")
    + [T.StructField("ts", T.TimestampType(), True), T.StructField("event_id", T.LongType(), True)]
)

USERS = T.StructType([T.StructField("uid", T.StringType(), False)] + _strings("email", "photoUrl", "displayName"))
