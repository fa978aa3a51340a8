"""The trends job: item table in, scored-term table out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from feedtide.operators import tfidf
from feedtide.session import staged
from feedtide.sinks.tables import overwrite_terms
from feedtide.sources.items import distinct_items, keyed_documents


@dataclass(frozen=True)
class TermInputs:
    """What every scoring step reads.

    ``docs`` are the pooled texts, ``counts`` their staged ``tfidf.pooled_counts``,
    ``frequencies`` the staged (word, n_docs), ``attributes`` (uri, feedUrl).
    """

    docs: DataFrame
    counts: DataFrame
    frequencies: DataFrame
    attributes: DataFrame


def term_inputs(items: DataFrame) -> TermInputs:
    """Scan, dedupe and count an item table once. ``distinct_items(items, limit)`` gives a limited table to start from."""
    docs = keyed_documents(distinct_items(items))
    attributes = keyed_documents(items.where("link is not null"))
    counts = staged(tfidf.pooled_counts(attributes), "term-counts")
    frequencies = staged(tfidf.doc_freqs(counts), "doc-freqs")
    return TermInputs(docs, counts, frequencies, attributes.select("uri", "feedUrl"))


def score_terms(inputs: TermInputs) -> DataFrame:
    """(word, uri, tfidf, n_docs, firstFeed, n_feeds)."""
    return tfidf.scores(inputs.counts, inputs.frequencies, inputs.attributes)


def terms_by_feed(inputs: TermInputs, feed_scope: str = "word", score: Column | str = "tfidf") -> DataFrame:
    """Four-column scored terms, fanned out to feeds.

    ``feed_scope`` is "word" (every feed using the word, corpus-wide) or
    "document" (the document's own feeds). In word scope the un-fanned scores
    are staged, because the fan-out reads them several times. ``score`` may be an expression
    of a score that stands for it, told before scores are fanned out.
    """
    scored = score_terms(inputs)
    if isinstance(score, Column):
        scored = scored.withColumn("tfidf", score)
    if feed_scope == "word":
        fanned = tfidf.fan_out_by_word(staged(scored, "scores"), inputs.frequencies)
    elif feed_scope == "document":
        fanned = tfidf.fan_out_by_document(scored, inputs.attributes)
    else:
        raise ValueError(f"unknown feed_scope {feed_scope!r}")
    return tfidf.output_rows(fanned)


def run(items: DataFrame, path: str, feed_scope: str = "word") -> None:
    """Compute the scored terms and replace the table at ``path``."""
    overwrite_terms(terms_by_feed(term_inputs(items), feed_scope), path)
