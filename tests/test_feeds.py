"""Landed feed documents: dialects, field mapping, dates and quarantine."""

import datetime as dt

from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.functions.dates import feed_time, iso_utc
from feedtide.functions.text import snippet
from feedtide.sources import feeds

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a comment with <feed> in it -->
<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>T</title><link>http://x</link>
<atom:link href="http://hub" rel="hub"/><atom:link href="http://x/feed" rel="self" type="application/rss+xml"/>
<item><title>A &amp; B</title><link>http://x/1</link><pubDate>Fri, 06 Aug 2021 02:41:16 GMT</pubDate>
<dc:creator>me</dc:creator><description><![CDATA[<p>hi &amp; <b>you</b></p>]]></description>
<guid isPermaLink="false">g1</guid></item>
<item><title>no link</title></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><link rel="self" href="http://a/self"/>
<entry><id>1</id><title type="html">one</title><updated>2021-08-06T02:41:16.782Z</updated><link href="http://a/1"/></entry>
<entry><id>2</id><title>two</title><updated>2021-08-07T02:41:16.782Z</updated>
<link rel="enclosure" href="http://a/mp3"/><link href="http://a/2"/></entry></feed>"""
NO_SELF = '<rss version="2.0"><channel><title>T</title><item><title>x</title><link>http://n/1</link></item></channel></rss>'
EMPTY_ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><link rel="self" href="http://e"/></feed>'


def landed(spark, **documents):
    now = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, v, now) for k, v in documents.items()], schemas.RAW_FEEDS)


def everything(spark):
    return landed(
        spark, rss=RSS, atom=ATOM, noself=NO_SELF, empty=EMPTY_ATOM,
        broken="<rss><channel><item>", html="<html><body>hi</body></html>", text="hello", nothing=None,
    )


def test_types(spark):
    got = {r.uri: r.type for r in feeds.feed_types(everything(spark)).collect()}
    assert got == {
        "rss": feeds.RSS, "atom": feeds.ATOM, "noself": feeds.RSS, "empty": feeds.ATOM,
        "broken": None, "html": None, "text": None, "nothing": None,
    }


def test_rss_items(spark):
    rows = {r.link: r for r in feeds.rss_items(everything(spark)).collect()}
    assert set(rows) == {"http://x/1", "http://a/1", "http://a/2"}
    item = rows["http://x/1"]
    assert item.title == "A & B" and item.creator == "me" and item.guid == "g1"
    assert item.pubDate == "Fri, 06 Aug 2021 02:41:16 GMT"
    assert item.isoDate == "2021-08-06T02:41:16.000Z"
    assert item.content == "<p>hi &amp; <b>you</b></p>" and item.contentSnippet == "hi & you"
    assert item.feedUrl == "http://x/feed"
    assert rows["http://a/1"].feedUrl == "http://a/self"
    assert rows["http://a/1"].isoDate == "2021-08-06T02:41:16.782Z"
    assert feeds.rss_items(everything(spark)).columns == list(schemas.RSS_ITEM_COLUMNS)


def test_quarantine(spark):
    got = sorted((r.uri, r.title, r.reason) for r in feeds.quarantine(everything(spark)).fillna("-").collect())
    assert got == [
        ("broken", "-", "malformed_xml"), ("html", "-", "not_a_feed"), ("noself", "-", "missing_feed_url"),
        ("nothing", "-", "not_a_feed"), ("rss", "no link", "missing_link"), ("text", "-", "not_a_feed"),
    ]


def test_reader_items(spark):
    rows = {(r.feed_uri, r.title): r for r in feeds.feed_items(everything(spark)).collect()}
    assert set(rows) == {("rss", "A & B"), ("rss", "no link"), ("atom", "one"), ("noself", "x")}
    assert rows["atom", "one"].dateTime == dt.datetime(2021, 8, 6, 2, 41, 16, 782000)
    assert rows["rss", "A & B"].dateTime == dt.datetime(2021, 8, 6, 2, 41, 16)
    entries = feeds.feed_entries(everything(spark))
    split = feeds.rss_feed_items(entries).unionByName(feeds.atom_feed_items(entries))
    assert sorted(map(str, split.collect())) == sorted(map(str, rows.values()))
    bad = [(r.uri, r.title) for r in feeds.feed_item_quarantine(everything(spark)).where("reason = 'not_one_link'").collect()]
    assert bad == [("atom", "two")]


def test_subscriptions(spark, tmp_path):
    rows = [("u1", "f1", feeds.RSS, "rss", None), ("u2", "f2", feeds.RSS, "rss", None), ("u2", "f3", None, None, None)]
    subs = spark.createDataFrame(rows, schemas.FEED_URIS)
    assert [r.uri for r in feeds.subscribed_uris(subs).collect()] == ["rss"]
    when = dt.datetime(2024, 5, 6)
    asked = spark.createDataFrame(
        [("u", "atom", when), ("u", "html", when), ("v", "gone", when)], "user_id string, uri string, requested_at timestamp"
    )
    rows, path = feeds.new_subscriptions(asked, everything(spark)), str(tmp_path / "subscriptions")
    for _ in range(2):
        feeds.append_subscriptions(rows, path)
    added = spark.read.parquet(path).collect()
    assert [(r.user_id, r.type, r.uri, r.timestamp) for r in added] == [("u", feeds.ATOM, "atom", when)]
    refused = feeds.refused_subscriptions(asked, everything(spark)).collect()
    assert sorted((r.uri, r.reason) for r in refused) == [("gone", "not_landed"), ("html", "not_a_feed")]


def test_dates(spark):
    cases = {
        "Fri, 06 Aug 2021 02:41:16 GMT": "2021-08-06T02:41:16.000Z",
        "Fri, 06 Aug 2021 02:41:16 +0900": "2021-08-05T17:41:16.000Z",
        "6 Aug 2021 02:41 EST": "2021-08-06T07:41:00.000Z",
        "2021-08-06T02:41:16.782Z": "2021-08-06T02:41:16.782Z",
        "2021-08-06T02:41:16+09:00": "2021-08-05T17:41:16.000Z",
        "soon": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "d string")
    got = {r.d: r.iso for r in frame.select("d", iso_utc(feed_time(F.col("d"))).alias("iso")).collect()}
    assert got == cases


def test_snippet(spark):
    frame = spark.createDataFrame([("one<br>two&lt;&amp;lt; <a href='x'>y</a>\n",), ("it&#8217;s caf&eacute;&nbsp;x",), (None,)], "h string")
    assert [r.s for r in frame.select(snippet(F.col("h")).alias("s")).collect()] == ["one\ntwo<&lt; y", "it’s café x", None]


def test_title_terms(spark):
    rows = [("a", "The the_cat 42 the Ca-t é", "f"), ("a", "The the_cat 42 the Ca-t é", "f"), ("b", None, "f")]
    items = spark.createDataFrame(rows, "link string, title string, feedUrl string")
    got = {r.term: r.n for r in feeds.title_term_counts(items).collect()}
    assert got == {"The": 1, "the_cat": 1, "42": 1, "the": 1, "Ca": 1, "t": 1}


def test_terms_are_not_shuffled(spark):
    """Titles are shuffled by item once; what they hold is counted in the same task, null and repeated titles as before."""
    rows = [("l", "a A b1 a", "f"), ("l", "a A b1 a", "f"), ("l", None, "f"), ("l", "a", "g"), (None, "a", None)]
    counts = feeds.title_term_counts(spark.createDataFrame(rows, "link string, title string, feedUrl string"))
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    got = sorted((r.link or "", r.feedUrl or "", r.term, r.n) for r in counts.collect())
    assert got == [("", "", "a", 1), ("l", "f", "A", 1), ("l", "f", "a", 2), ("l", "f", "b1", 1), ("l", "g", "a", 1)]
