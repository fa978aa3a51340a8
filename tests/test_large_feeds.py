"""Feeds in files give the rows and the quarantine of the same feeds in rows, by several tasks a file."""

import datetime as dt

import pytest

from feedtide import schemas
from feedtide.sources import feeds, large_feeds

T0 = dt.datetime(2024, 1, 1)
RSS_HEAD = '<?xml version="1.0"?>\n<rss xmlns:atom="a"><channel><title>t</title>'
SELF = '<atom:link rel="self" href="http://x"/>'


def _items(n):
    return "\n".join(
        f'<item><title>t{i} &amp; more</title>{"" if i % 9 == 4 else f"<link>http://x/{i}</link>"}'
        f"<description><![CDATA[<b>{i}</b> text]]></description></item>"
        for i in range(n)
    )


def _entries(n):
    return "".join(f'<entry><id>{i}</id><title>t{i}</title><link href="http://y/{i}"/></entry>' for i in range(n))


DOCUMENTS = {
    feeds.RSS: {
        "large": RSS_HEAD + SELF + _items(3000) + "</channel></rss>",
        "late-address": RSS_HEAD + _items(5) + SELF + "\n</channel></rss>\n",
        "cut": RSS_HEAD + SELF + _items(4),
        "unnamed": RSS_HEAD + _items(4) + "</channel></rss>",
        "broken": RSS_HEAD + SELF + _items(2) + "<item><title>a</b></item></channel></rss>",
        "none": RSS_HEAD + SELF + "</channel></rss>",
        "page": "<html><p>no feed</p></html>",
    },
    feeds.ATOM: {
        "atom": '<feed xmlns="w"><link rel="self" href="http://y"/>' + _entries(40) + "</feed>",
        "atom-cut": '<feed xmlns="w"><link rel="self" href="http://y"/>' + _entries(3),
    },
}


@pytest.mark.parametrize("dialect", [feeds.RSS, feeds.ATOM])
def test_files_equal_rows(spark, tmp_path, dialect):
    for name, xml in DOCUMENTS[dialect].items():
        (tmp_path / name).write_text(xml)
    rows = spark.createDataFrame([(n, x, T0) for n, x in DOCUMENTS[dialect].items()], schemas.RAW_FEEDS)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        if dialect == feeds.RSS:
            assert large_feeds._records(spark, str(tmp_path / "large"), dialect).rdd.getNumPartitions() > 4
        got = large_feeds.read(spark, str(tmp_path), dialect)
        for hot in (None, 10):
            items = large_feeds.rss_items(got, hot)
            assert sorted(map(str, items.collect())) == sorted(map(str, feeds.rss_items(rows).collect()))
        lost = [(r.uri.rsplit("/", 1)[1], r.title, r.reason) for r in large_feeds.quarantine(got).collect()]
        assert sorted(map(str, lost)) == sorted(str(tuple(r)) for r in feeds.quarantine(rows).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
