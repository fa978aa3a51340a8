"""TF-IDF over pooled document texts.

A document is a ``uri``; its texts are all distinct (title, uri, feedUrl) rows,
pooled. Shape of the job (``pooled_counts``): texts are shuffled by document, and all
that follows from one document, its words' counts, length and feeds, is told in the
same task, so counts are never shuffled. They are read by several branches, so the
plans stage them (``session.staged``): each branch then scans just its columns, and
texts are tokenized once. Scores join them with the words' document frequencies only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.functions.text import inverse_document_frequency, raw_words
from feedtide.operators.skew import attach_per_key, hot_keys, salted_join
from feedtide.session import staged

#: Documents of this many texts are counted in several tasks; words in this many documents may be joined map-side.
HOT_TEXTS, HOT_WORD_ROWS = 10_000, 1_000
#: Feeds of a word that travel as one list, about.
FEEDS_A_LIST = 100


def tokens(docs: DataFrame) -> DataFrame:
    """(uri, word), one row per occurrence; documents with a null title give none."""
    return docs.select("uri", F.explode(raw_words("title")).alias("_raw")).select(
        "uri", F.lower("_raw").alias("word")
    )


def doc_count(docs: DataFrame) -> DataFrame:
    """Number of distinct documents, those without any word included."""
    return docs.agg(F.count_distinct("uri").alias("n_docs_total"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(uri, word, n). Counts combine map-side, then shuffle by (uri, word)."""
    return tokens(docs).groupBy("uri", "word").agg(F.count(F.lit(1)).alias("n"))


def pooled_counts(rows: DataFrame, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """(uri, word, n, doc_length, firstFeed, n_feeds), one row per (uri, word).

    ``rows`` are (uri, title, feedUrl), repeats included. ``n_feeds`` counts the feeds of a document, null as one.
    Documents of very many texts are counted by (uri, word) in several tasks; they are at most ``skew.MAX_HOT_KEYS``.
    """
    sizes = rows.groupBy("uri").agg(F.count(F.lit(1)).alias("_texts"))
    hot = F.broadcast(staged(hot_keys(sizes, "_texts", hot_texts).select("uri"), "hot-documents"))
    pooled = (
        rows.join(hot, "uri", "left_anti")
        .repartition("uri")
        .groupBy("uri")
        .agg(F.collect_set(F.struct("title", "feedUrl")).alias("_rows"))
        .withColumn("_words", F.flatten(F.transform(F.filter("_rows", lambda r: r["title"].isNotNull()), lambda r: raw_words(r["title"]))))
    )
    of_document = ["doc_length", "firstFeed", "n_feeds"]
    words = pooled.select(
        "uri",
        F.size("_words").cast("long").alias("doc_length"),
        F.array_min("_rows.feedUrl").alias("firstFeed"),
        F.size(F.array_distinct("_rows.feedUrl")).alias("n_feeds"),
        F.explode_outer("_words").alias("_raw"),  # an inner one would have the words made again, to filter by their number
    ).where("_raw is not null")
    cold = words.groupBy("uri", F.lower("_raw").alias("word"), *of_document).agg(F.count(F.lit(1)).alias("n"))
    many = rows.join(hot, "uri").distinct()
    counts = term_counts(many)
    feeds = doc_feeds(many).groupBy("uri").agg(F.min("feedUrl").alias("firstFeed"), F.count(F.lit(1)).cast("int").alias("n_feeds"))
    per_doc = F.broadcast(doc_lengths(counts).join(feeds, "uri"))
    columns = ["uri", "word", "n", *of_document]
    return cold.select(*columns).unionByName(counts.join(per_doc, "uri").select(*columns))


def doc_lengths(counts: DataFrame) -> DataFrame:
    """(uri, doc_length): words per document."""
    return counts.groupBy("uri").agg(F.sum("n").alias("doc_length"))


def doc_freqs(counts: DataFrame) -> DataFrame:
    """(word, n_docs): documents per word.

    ``counts`` is distinct in (uri, word) already, so rows are documents.
    """
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def doc_freq_ratios(counts: DataFrame, attributes: DataFrame) -> DataFrame:
    """(word, df): share of all documents that hold the word."""
    return doc_freqs(counts).select("word", (F.col("n_docs") / doc_count(attributes).scalar()).alias("df"))


def term_freqs(counts: DataFrame) -> DataFrame:
    """(uri, word, tf): occurrences over document length."""
    if "doc_length" not in counts.columns:
        counts = counts.join(doc_lengths(counts), "uri")
    return counts.select(
        "uri", "word", (F.col("n") / F.col("doc_length")).alias("tf")
    )


def first_feeds(docs: DataFrame) -> DataFrame:
    """(uri, firstFeed): one feed per document, the smallest by name."""
    return docs.groupBy("uri").agg(F.min("feedUrl").alias("firstFeed"))


def doc_feeds(docs: DataFrame) -> DataFrame:
    """(uri, feedUrl): every feed of a document."""
    return docs.select("uri", "feedUrl").distinct()


def word_feeds(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, feedUrl): distinct feeds that use a word, one feed per document."""
    if "firstFeed" not in counts.columns:
        counts = counts.join(first_feeds(docs), "uri")
    return (
        counts.select("word", F.col("firstFeed").alias("feedUrl"))
        .distinct()
    )


def scores(
    counts: DataFrame,
    frequencies: DataFrame,
    attributes: DataFrame,
    min_hot_rows: int | None = None,
) -> DataFrame:
    """(word, uri, tfidf, n_docs, firstFeed[, n_feeds]), one row per (word, document).

    ``counts`` is ``pooled_counts`` or ``term_counts``, which then meets its documents
    by a join, and ``frequencies`` its ``doc_freqs``, both staged. ``attributes`` are the (uri, feedUrl) rows the counts came from;
    repeats do no harm, so the raw scan will do and costs two narrow columns
    instead of the texts.
    The document frequency is attached first: rows of frequent words, the bulk
    by Zipf's law, get it without a shuffle.
    """
    total = doc_count(attributes).scalar()
    hot = HOT_WORD_ROWS if min_hot_rows is None else min_hot_rows
    with_df = attach_per_key(counts, frequencies, ["word"], "n_docs", hot, stage=False)
    if "doc_length" not in counts.columns:
        with_df = with_df.join(doc_lengths(counts).join(first_feeds(attributes), "uri"), "uri")
    return with_df.select(
        "word",
        "uri",
        (
            F.col("n") / F.col("doc_length") * inverse_document_frequency(F.col("n_docs") / total)
        ).alias("tfidf"),
        "n_docs",
        "firstFeed",
        *[c for c in counts.columns if c == "n_feeds"],
    )


def fan_out_by_word(
    scored: DataFrame, frequencies: DataFrame, min_hot_rows: int | None = None
) -> DataFrame:
    """(word, feedUrl, uri, tfidf): every score of a word, once per feed using the word.

    The pairing is corpus-wide, not tied to the document's own feeds. A word's feeds travel as lists of about
    ``FEEDS_A_LIST``, so a join makes a row a list and a list is opened where it is. Scores of hot words with one list meet
    it map-side; other words that make very many pairs are cut over their documents and lists alike. ``scored`` is read
    several times, so it should be a table.
    """
    feeds = scored.select("word", F.col("firstFeed").alias("feedUrl")).distinct()
    rows = scored.select("word", "uri", "tfidf")
    per_word = staged(feeds.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs")), "feeds-per-word")
    part = F.pmod(F.xxhash64("feedUrl"), F.ceil(F.col("n_docs") / FEEDS_A_LIST)).alias("part")
    lists = feeds.join(per_word, "word").groupBy("word", "n_docs", part).agg(F.collect_list(F.struct("feedUrl")).alias("feeds"))
    lists = staged(lists, "feed-lists")
    hot = hot_keys(frequencies, "n_docs", HOT_WORD_ROWS if min_hot_rows is None else min_hot_rows).select("word")
    hot = lists.where(F.col("n_docs") <= FEEDS_A_LIST).join(hot, "word", "left_semi").select("word", "feeds")
    names = F.broadcast(hot.select("word"))
    cold = salted_join(
        rows.join(names, "word", "left_anti"),
        lists.select("word", "part", "feeds").join(names, "word", "left_anti"),
        ["word"],
        [F.col("uri")],
        frequencies,
        "n_docs",
        right_spread=[F.col("part")],
        right_sizes=per_word,
        min_rows=min_hot_rows,
    )
    opened = F.inline("feeds")
    columns = ["word", "feedUrl", "uri", "tfidf"]
    of_hot = rows.join(F.broadcast(hot), "word").select("word", "uri", "tfidf", opened).select(*columns)
    return of_hot.unionByName(cold.select("word", "uri", "tfidf", opened).select(*columns))


def fan_out_by_document(
    scored: DataFrame, attributes: DataFrame, min_hot_rows: int | None = None
) -> DataFrame:
    """(word, feedUrl, uri, tfidf): every score, once per feed the document came from.

    Where ``scored`` has ``n_feeds``, only documents of several feeds are joined with them.
    """
    feeds = doc_feeds(attributes)
    several, columns = scored, ["word", "feedUrl", "uri", "tfidf"]
    if "n_feeds" in scored.columns:
        several = scored.where("n_feeds > 1")
        feeds = feeds.join(feeds.groupBy("uri").count().where("count > 1").select("uri"), "uri", "left_semi")
    per_doc = feeds.groupBy("uri").agg(F.count(F.lit(1)).alias("n_feeds"))
    rows = several.select("word", "uri", "tfidf")
    joined = salted_join(
        feeds, rows, ["uri"], [F.col("feedUrl")], per_doc, "n_feeds", min_rows=min_hot_rows
    ).select(*columns)
    if "n_feeds" not in scored.columns:
        return joined
    return scored.where("n_feeds = 1").withColumnRenamed("firstFeed", "feedUrl").select(*columns).unionByName(joined)


def output_rows(by_feed: DataFrame) -> DataFrame:
    """Four-column table shape."""
    return by_feed.select("word", "uri", "tfidf", "feedUrl")


def output_rows_without_feed(scored: DataFrame) -> DataFrame:
    """Three-column table shape."""
    return scored.select("word", "uri", "tfidf")


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word): distinct words."""
    return rows.select("word").distinct()


def document_list(rows: DataFrame) -> DataFrame:
    """(uri): distinct documents in order."""
    return rows.select("uri").distinct().orderBy("uri")


def uri_terms(rows: DataFrame) -> DataFrame:
    """(uri, terms): all (word, tfidf) of a document, sorted, duplicates kept.

    Rows are shuffled as they are: lists of a few, made before the shuffle, would be larger.
    """
    return rows.select("uri", "word", "tfidf").repartition("uri").groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("word", "tfidf"))).alias("terms"))


def uri_feeds(rows: DataFrame) -> DataFrame:
    """(uri, feeds): distinct feeds of a document, sorted."""
    return (
        rows.select("uri", "feedUrl")
        .distinct()
        .groupBy("uri")
        .agg(F.sort_array(F.collect_list("feedUrl")).alias("feeds"))
    )
