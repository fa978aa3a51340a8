"""Landed feed documents to item rows.

A landed row is ``(uri, xml, fetched_at)``. Both dialects are parsed in one pass
by the built-in XML reader against one schema; a bad document only costs its own
rows, which go to a quarantine with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.functions.dates import feed_time, iso_utc
from feedtide.functions.text import snippet, title_terms
from feedtide.session import path_exists, staged

# Names of the two dialects in stored subscriptions.
RSS = "FeedTypes.RSS"
ATOM = "FeedTypes.ATOM"

_TEXT = "struct<_VALUE:string,_type:string>"
_LINKS = "array<struct<_href:string,_rel:string>>"
_RSS_ITEM = (
    "struct<title:string,link:string,pubDate:string,`dc:creator`:string,author:string,"
    "description:string,guid:struct<_VALUE:string,_isPermaLink:string>>"
)
_ENTRY = (
    f"struct<id:string,title:{_TEXT},updated:string,published:string,link:{_LINKS},"
    f"content:{_TEXT},author:array<struct<name:string>>>"
)
FEED_SCHEMA = (
    f"channel struct<title:string,`atom:link`:{_LINKS},item:array<{_RSS_ITEM}>>,"
    f"item array<{_RSS_ITEM}>,link {_LINKS},entry array<{_ENTRY}>,_corrupt_record string"
)

# The name of the root element, past declaration, comments and doctype.
_ROOT = r"(?s)^\uFEFF?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*+<([A-Za-z_][A-Za-z0-9_:.\-]*)"


def subscribed_uris(feed_uris: DataFrame) -> DataFrame:
    """(uri) of every subscription of every user, each feed once.

    Reading a shared feed once instead of once per subscriber changes nothing
    downstream: the item scan is distinct.
    """
    return feed_uris.where(F.col("uri").isNotNull()).select("uri").distinct()


def parse_feeds(raw_feeds: DataFrame) -> DataFrame:
    """Add ``root`` and the parsed ``feed``, and classify into ``type`` or ``reason``.

    The XML reader does not check the root element and gives nulls for the other
    dialect, so the root name decides, and the parse must have succeeded.
    """
    parsed = raw_feeds.select(
        "uri",
        "fetched_at",
        F.regexp_extract("xml", _ROOT, 1).alias("root"),
        F.from_xml("xml", FEED_SCHEMA, {"ignoreSurroundingSpaces": "true"}).alias("feed"),
    )
    sound = F.col("feed").isNotNull() & F.col("feed._corrupt_record").isNull()
    is_rss = F.col("root").isin("rss", "rdf:RDF")
    is_atom = F.col("root") == "feed"
    return parsed.withColumn(
        "type", F.when(sound & is_rss, RSS).when(sound & is_atom, ATOM)
    ).withColumn(
        "reason",
        F.when(F.col("type").isNotNull(), None)
        .when(is_rss | is_atom, "malformed_xml")
        .otherwise("not_a_feed"),
    )


def feed_types(raw_feeds: DataFrame) -> DataFrame:
    """(uri, type): dialect of every landed document; null where it is neither."""
    return parse_feeds(raw_feeds).select("uri", "type")


def _judged_requests(requests: DataFrame, raw_feeds: DataFrame) -> DataFrame:
    """Requests with the dialect of the feed they name. Only a column or two of each side is
    joined, and the engine splits a feed that very many ask for."""
    landed = feed_types(raw_feeds).groupBy("uri").agg(F.min("type").alias("type"), F.lit(True).alias("_landed"))
    return requests.join(landed, "uri", "left")


def new_subscriptions(requests: DataFrame, raw_feeds: DataFrame) -> DataFrame:
    """Rows to append to ``feed_uris`` for (user_id, uri, requested_at) requests.

    The feed_id is a hash of the request, so a repeated run makes the same rows. What
    ``refused_subscriptions`` lists adds none.
    """
    rows = _judged_requests(requests, raw_feeds).where("type is not null")
    feed_id = F.sha2(F.concat_ws("\u0001", "user_id", "uri", F.col("requested_at").cast("string")), 256)
    return rows.select("user_id", feed_id.alias("feed_id"), "type", "uri", F.col("requested_at").alias("timestamp"))


def append_subscriptions(rows: DataFrame, path: str) -> None:
    """Append ``new_subscriptions`` to the table at ``path``; those that are there already add nothing."""
    spark = rows.sparkSession
    if path_exists(spark, path):
        known = spark.read.parquet(path).select("user_id", "feed_id")
        rows = staged(rows.join(known, ["user_id", "feed_id"], "left_anti"), "new-subscriptions")
    rows.dropDuplicates(["user_id", "feed_id"]).write.mode("append").parquet(path)


def refused_subscriptions(requests: DataFrame, raw_feeds: DataFrame) -> DataFrame:
    """(user_id, uri, reason) of the requests whose feed has not landed or is no feed."""
    reason = F.when(F.col("_landed").isNull(), "not_landed").otherwise("not_a_feed")
    rows = _judged_requests(requests, raw_feeds).where("type is null")
    return rows.select("user_id", "uri", reason.alias("reason"))


def _entry_link(links: Column) -> Column:
    chosen = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.try_element_at(chosen, F.lit(1)), F.try_element_at(links, F.lit(1)))["_href"]


def feed_urls(parsed: DataFrame) -> DataFrame:
    """Add ``feedUrl``, the address a feed gives as its own."""
    links = F.when(F.col("type") == RSS, F.col("feed.channel")["atom:link"]).otherwise(F.col("feed.link"))
    own = F.try_element_at(F.filter(links, lambda l: l["_rel"] == "self"), F.lit(1))["_href"]
    return parsed.withColumn("feedUrl", own)


def _rss_entry(item: Column) -> Column:
    return F.struct(
        item["title"].alias("title"),
        item["link"].alias("link"),
        F.lit(1).alias("n_links"),
        item["pubDate"].alias("pubDate"),
        F.coalesce(item["dc:creator"], item["author"]).alias("creator"),
        item["description"].alias("content"),
        item["guid"]["_VALUE"].alias("guid"),
        item["link"].alias("reader_uri"),
        item["pubDate"].alias("reader_time"),
    )


def _atom_entry(item: Column) -> Column:
    return F.struct(
        item["title"]["_VALUE"].alias("title"),
        _entry_link(item["link"]).alias("link"),
        F.coalesce(F.size(item["link"]), F.lit(0)).alias("n_links"),
        iso_utc(feed_time(F.coalesce(item["updated"], item["published"]))).alias("pubDate"),
        F.lit(None).cast("string").alias("creator"),
        item["content"]["_VALUE"].alias("content"),
        F.lit(None).cast("string").alias("guid"),
        F.try_element_at(item["link"], F.lit(1))["_href"].alias("reader_uri"),
        item["updated"].alias("reader_time"),
    )


def feed_entries(raw_feeds: DataFrame) -> DataFrame:
    """One row per entry of either dialect, or one row with a null ``item`` per document without any.

    Columns: uri, fetched_at, type, reason, feedUrl, the entry's place ``pos`` in
    its document, and the ``item`` fields both views of a feed need. The document
    is parsed once for all of them.
    """
    none = F.array().cast(f"array<{_RSS_ITEM}>")
    in_channel, beside_channel = F.col("feed.channel.item"), F.col("feed.item")
    rss = F.transform(F.concat(F.coalesce(in_channel, none), F.coalesce(beside_channel, none)), _rss_entry)
    atom = F.transform("feed.entry", _atom_entry)
    entries = F.when(F.col("type") == RSS, rss).when(F.col("type") == ATOM, atom)
    return feed_urls(parse_feeds(raw_feeds)).select(
        "uri", "fetched_at", "type", "reason", "feedUrl", F.posexplode_outer(entries).alias("pos", "item")
    )


def item_rows(entries: DataFrame, *extra: str) -> DataFrame:
    """The nine item columns of accepted entries, plus any ``extra`` ones."""
    return entries.select(
        *[F.col(f"item.{name}").alias(name) for name in ("title", "link", "pubDate", "creator", "content")],
        snippet(F.col("item.content")).alias("contentSnippet"),
        F.col("item.guid").alias("guid"),
        iso_utc(feed_time(F.col("item.pubDate"))).alias("isoDate"),
        "feedUrl",
        *extra,
    )


def judged_entries(raw_feeds: DataFrame) -> DataFrame:
    """``feed_entries`` with ``reason`` set on what the item table leaves out, null on its items.

    A document that is unusable as a whole stays as one row, its first; one that
    is fine but has no entries gives none.
    """
    whole = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.col("feedUrl").isNull(), "missing_feed_url"
    )
    single = F.when(F.col("item.link").isNull(), "missing_link")
    return (
        feed_entries(raw_feeds)
        .withColumn("_whole", whole)
        .where(F.when(F.col("_whole").isNotNull(), F.coalesce("pos", F.lit(0)) == 0).otherwise(F.col("pos").isNotNull()))
        .withColumn("reason", F.coalesce("_whole", single))
        .withColumn("rejected_title", F.when(F.col("_whole").isNull() & single.isNotNull(), F.col("item.title")))
        .drop("_whole")
    )


def rss_items(raw_feeds: DataFrame) -> DataFrame:
    """Item rows of all usable feeds: feeds without an own address and items without a link dropped."""
    return item_rows(judged_entries(raw_feeds).where(F.col("reason").isNull()))


def quarantine(raw_feeds: DataFrame) -> DataFrame:
    """(uri, title, reason): what ``rss_items`` leaves out.

    One row per document that is unusable as a whole, one per unusable item.
    """
    return judged_entries(raw_feeds).where(F.col("reason").isNotNull()).select(
        "uri", F.col("rejected_title").alias("title"), "reason"
    )


def title_term_counts(items: DataFrame) -> DataFrame:
    """(link, feedUrl, item, term, n): case-sensitive term counts per item title.

    ``item`` is a digest of the title, since one link may carry several titles;
    repeated ingests of one item are counted once. Titles are shuffled by item, so
    their terms need not be.
    """
    item = F.sha2(F.coalesce("title", F.lit("")), 256).alias("item")
    return (
        items.select("link", "feedUrl", "title", item)
        .repartition("link", "feedUrl", "item")
        .distinct()
        .select("link", "feedUrl", "item", F.explode(title_terms("title")).alias("term"))
        .groupBy("link", "feedUrl", "item", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _reader_rows(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("uri").alias("feed_uri"),
        F.col("type").alias("item_type"),
        F.col("item.title").alias("title"),
        F.col("item.reader_uri").alias("uri"),
        feed_time(F.col("item.reader_time")).alias("dateTime"),
    )


def rss_feed_items(entries: DataFrame) -> DataFrame:
    """RSS entries in the reader's shape: (feed_uri, item_type, title, uri, dateTime)."""
    return _reader_rows(entries.where((F.col("type") == RSS) & F.col("item").isNotNull()))


def atom_feed_items(entries: DataFrame) -> DataFrame:
    """Atom entries in the reader's shape; an entry must have exactly one link."""
    return _reader_rows(
        entries.where((F.col("type") == ATOM) & F.col("item").isNotNull() & (F.col("item.n_links") == 1))
    )


def feed_items(raw_feeds: DataFrame) -> DataFrame:
    """One item list from both dialects (both have n_links = 1 when well formed)."""
    return _reader_rows(
        feed_entries(raw_feeds).where(F.col("item").isNotNull() & (F.col("item.n_links") == 1))
    )


def feed_item_quarantine(raw_feeds: DataFrame) -> DataFrame:
    """(uri, title, reason): unusable documents, and Atom entries without exactly one link."""
    entries = feed_entries(raw_feeds)
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.col("item").isNotNull() & (F.col("item.n_links") != 1), "not_one_link"
    )
    return entries.select("uri", F.col("item.title").alias("title"), reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )
