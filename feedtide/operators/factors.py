"""The word-scoped fan-out kept as its two factors.

Fanned out, every score of a word stands once for each feed that uses the word: many times the rows of the scores. It is a
join of (word, uri, tfidf) with (word, feedUrl), and most of what is asked of it can be told from the factors:

- counts, sums and extremes per feed come from the same figures per word, met with the feeds of the word;
- counts and sums per document weigh each score with the number of feeds of its word;
- a lookup of some feeds, words or documents cuts the factors first, and expands what is left.

So the pairs are made only where they are asked for (``expand``). Figures per word are aggregates that combine map-side,
and words meet their figures by ``attach_per_key``, so frequent words are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.operators.skew import attach_per_key, salted_join
from feedtide.operators.tfidf import HOT_WORD_ROWS
from feedtide.session import staged


@dataclass(frozen=True)
class Factors:
    """``scores`` (word, uri, tfidf), ``feeds`` (word, feedUrl, distinct) and what each word has of them.

    ``words`` is (word, n_docs, n_feeds, tfidf_sum, tfidf_min, tfidf_max), one row a word that is in both.
    """

    scores: DataFrame
    feeds: DataFrame
    words: DataFrame


def factorise(scored: DataFrame) -> Factors:
    """The factors of ``tfidf.scores``, each written once."""
    scored = staged(scored.select("word", "uri", "tfidf", "firstFeed"), "factor-scores")
    feeds = staged(
        scored.where("firstFeed is not null").select("word", F.col("firstFeed").alias("feedUrl")).distinct(), "factor-feeds"
    )
    scores = scored.drop("firstFeed")
    return Factors(scores, feeds, staged(per_word(scores, feeds), "factor-words"))


def per_word(scores: DataFrame, feeds: DataFrame) -> DataFrame:
    """The figures of every word that has both scores and feeds."""
    of_scores = scores.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("tfidf").alias("tfidf_sum"),
        F.min("tfidf").alias("tfidf_min"),
        F.max("tfidf").alias("tfidf_max"),
    )
    of_feeds = feeds.groupBy("word").agg(F.count(F.lit(1)).alias("n_feeds"))
    return of_scores.join(of_feeds, "word").select("word", "n_docs", "n_feeds", "tfidf_sum", "tfidf_min", "tfidf_max")


def n_rows(factors: Factors) -> DataFrame:
    """One row: ``n_rows`` of the fan-out."""
    return factors.words.agg(F.coalesce(F.sum(F.col("n_docs") * F.col("n_feeds")), F.lit(0)).alias("n_rows"))


def feed_totals(factors: Factors, min_hot_rows: int | None = None) -> DataFrame:
    """(feedUrl, n_words, n_rows, tfidf_sum, tfidf_min, tfidf_max) over the fan-out's rows of every feed."""
    met = attach_per_key(factors.feeds, factors.words, ["word"], "n_feeds", min_hot_rows, stage=False)
    return met.groupBy("feedUrl").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.sum("n_docs").alias("n_rows"),
        F.sum("tfidf_sum").alias("tfidf_sum"),
        F.min("tfidf_min").alias("tfidf_min"),
        F.max("tfidf_max").alias("tfidf_max"),
    )


def document_totals(factors: Factors, min_hot_rows: int | None = None) -> DataFrame:
    """(uri, n_words, n_rows, tfidf_sum) over the fan-out's rows of every document."""
    widths = factors.words.select("word", "n_feeds", "n_docs")
    hot = HOT_WORD_ROWS if min_hot_rows is None else min_hot_rows
    met = attach_per_key(factors.scores, widths, ["word"], "n_docs", hot, stage=False)
    return met.groupBy("uri").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.sum("n_feeds").alias("n_rows"),
        F.sum(F.col("tfidf") * F.col("n_feeds")).alias("tfidf_sum"),
    )


def cut(
    factors: Factors, words: DataFrame | None = None, feeds: DataFrame | None = None, uris: DataFrame | None = None
) -> Factors:
    """The factors of the fan-out's rows of some words (word), feeds (feedUrl) and documents (uri).

    A cut of one factor leaves words in the other that nothing meets; their figures go, and ``expand`` joins them away.
    """
    scores, own = factors.scores, factors.feeds
    if words is not None:
        scores, own = scores.join(words, "word", "left_semi"), own.join(words, "word", "left_semi")
    if feeds is not None:
        own = own.join(feeds, "feedUrl", "left_semi")
    if uris is not None:
        scores = scores.join(uris, "uri", "left_semi")
    scores, own = staged(scores, "cut-scores"), staged(own, "cut-feeds")
    return Factors(scores, own, staged(per_word(scores, own), "cut-words"))


def expand(factors: Factors, min_hot_rows: int | None = None) -> DataFrame:
    """(word, uri, tfidf, feedUrl): the fan-out's rows themselves. Words that make very many are cut on both sides."""
    sizes = factors.words
    return salted_join(
        factors.scores,
        factors.feeds,
        ["word"],
        [F.col("uri")],
        sizes.select("word", "n_docs"),
        "n_docs",
        right_spread=[F.col("feedUrl")],
        right_sizes=sizes.select("word", F.col("n_feeds").alias("n_docs")),
        min_rows=min_hot_rows,
    ).select("word", "uri", "tfidf", "feedUrl")


def write(factors: Factors, path: str) -> None:
    """Store the factors below ``path``, which must be new; the figures last, so that what has them is whole."""
    for name in ("scores", "feeds", "words"):
        getattr(factors, name).write.parquet(f"{path.rstrip('/')}/{name}")


def read(spark: SparkSession, path: str) -> Factors:
    """Factors that ``write`` stored."""
    return Factors(*(spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("scores", "feeds", "words")))
