"""Tokenizers and key encoding."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a word of a document, and as a term of a title.
WORD_PATTERN = r"[A-Za-z']+"
TERM_PATTERN = r"[A-Za-z0-9_]+"


def raw_words(text: Column | str) -> Column:
    """All words of a text in order, in their original case; null text gives null.

    Lower-casing must follow the match: a few non-ASCII letters lower-case into
    ASCII ones (the Kelvin sign, for one) and would otherwise become words.
    """
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(WORD_PATTERN), F.lit(0))


def title_terms(title: Column | str) -> Column:
    """Case-sensitive terms of a title, digits and underscores kept."""
    return F.regexp_extract_all(F.col(title) if isinstance(title, str) else title, F.lit(TERM_PATTERN), F.lit(0))


def path_key(value: Column | str) -> Column:
    """A key that is safe as one path segment. Not injective: see ``quality.key_collisions``."""
    return F.translate(value, "/", "_")


def inverse_document_frequency(ratio: Column) -> Column:
    """Natural log of 1 / (share of documents that hold the word)."""
    return F.log(F.lit(1.0) / ratio)


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def snippet(markup: Column) -> Column:
    """Plain text of an HTML fragment: tags dropped, character references decoded, trimmed.

    Named and numeric references are decoded once, by the table of the HTML standard; a
    no-break space becomes a space. Only texts that hold one go through Python.
    """
    # Block elements that part words.
    block = r"(?s)([^\n])</?(?:h|br|p|ul|ol|li|blockquote|section|table|tr|div)(?:[^>]*)>([^\n])"
    text = F.regexp_replace(markup, block, "$1\n$2")
    text = F.regexp_replace(text, r"(?s)<.*?>", "")
    text = F.when(F.contains(text, F.lit("&")), F.replace(_unescaped(text), F.lit("\u00a0"), F.lit(" "))).otherwise(text)
    return F.regexp_replace(text, r"^\s+|\s+$", "")
