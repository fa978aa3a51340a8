"""Dedup of content-defined line chunks (operator 3).

Every line of a text gets a hash, and a rolling hash over the last ``WINDOW`` line hashes ends a chunk wherever it is a
multiple of ``DIVISOR``. An end depends on the lines just before it only, so a passage is cut the same way wherever it
stands and whatever was inserted before it. Blank lines at a chunk's ends are not part of it. Chunks of two lines or more
that occur again, in any text or the same, are removed; the first occurrence (smallest doc_id, then place) stays. Chunks
are told apart by their digest first; those whose digest repeats are then grouped by their bytes, so only equal chunks
count as repeated.

A repeated passage begins and ends inside chunks that are not equal, and short ones hold no whole chunk. So what the chunks
left is cut once more, at every end there can be: two neighbouring lines, of which one has a word, and blank lines with the
line after. These are compared in the same way, but for those inside a chunk that is removed already. All lines of a passage
of two lines or more that stood earlier are in such a piece, so the whole passage goes. A piece that shares a line with its
own first occurrence stays with it. The second cut finds all that the first one finds, so the first decides nothing but how
much is left to compare: long passages and copies, the bulk, carry their bytes once and not twice.

Chunks are aggregated before they are shuffled, so one that is in a third of all texts costs a row a task. The join that
finds its copies is an inner join on the chunk, which the engine splits when one side is hot.

Defined results: a null text stays null and an empty one stays empty; rows that share a doc_id but not the text are
documents of their own, of which the smaller digest comes first; full copies of a row are one document, and each gets its
result; a null doc_id comes after all others. Blank lines are lines. Lines are what ``\\n`` separates. Other columns are
carried by ``dedup``, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.llm.common import WORD, bit_map, columns_apart, maybe_in
from feedtide.session import staged

WINDOW = 2
DIVISOR = 3
LEAST_LINES = 2
_MODULUS = 1_000_003


def _line_hash(line: Column) -> Column:
    """28 bits of a digest that any engine has."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _rolling(hashes: Column, i: Column) -> Column:
    """Polynomial hash of the ``WINDOW`` lines that end with line ``i`` (from 0); lines before the first count as 0."""
    total = F.lit(0).cast("long")
    for back in range(WINDOW - 1, -1, -1):
        own = F.when(i >= back, F.element_at(hashes, (i - back + 1).cast("int"))).otherwise(F.lit(0))
        total = (total * 31 + own) % _MODULUS
    return total


def _rows(docs: DataFrame, *others: str) -> DataFrame:
    """Texts by line, with the line numbers (from 1) of lines that have a word."""
    lines = F.split("text", "\n", -1)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("text_digest"), lines.alias("lines"), *others)
    worded = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("lines", i - 1).rlike(WORD))
    return rows.withColumn("worded", worded)


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, text_digest, first, last`` (line numbers from 1), ``chunk``: all chunks of ``LEAST_LINES`` or more."""
    rows = _rows(docs).withColumn("hashes", F.transform("lines", _line_hash))
    n = F.size("lines")
    ends = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == n) | (_rolling(F.col("hashes"), i - 1) % DIVISOR == 0),
    )
    rows = rows.withColumn("ends", ends)
    spans = F.transform(
        "ends",
        lambda end, k: F.sequence(F.when(k == 0, 0).otherwise(F.get("ends", k - 1)) + 1, end),
    )
    told = F.transform(spans, lambda span: F.filter(span, lambda i: F.get("lines", i - 1).rlike(WORD)))
    rows = rows.withColumn("told", F.filter(told, lambda t: F.size(t) > 0))
    trimmed = F.transform("told", lambda t: F.struct(F.get(t, F.lit(0)).alias("first"), F.get(t, F.size(t) - 1).alias("last")))
    return _cut_out(rows, F.filter(trimmed, lambda s: s["last"] - s["first"] + 1 >= LEAST_LINES))


def _code(first: Column, last: Column) -> Column:
    """A span as one number, so that sets of spans are hashed."""
    return F.shiftleft(first.cast("long"), 32) + last


def _pieces(stops: Column) -> Column:
    """Codes of the pieces between one stop and the next."""

    def between(a: Column, k: Column) -> Column:
        b = F.get(stops, k + 1)
        pairs = F.array(
            _code(a, a + 1), F.when(b - a >= 2, _code(b - 1, b)), F.when(b - a >= 3, _code(a + 1, b))
        )
        return F.filter(pairs, lambda p: p.isNotNull())

    return F.flatten(F.transform(F.slice(stops, F.lit(1), F.greatest(F.size(stops) - 1, F.lit(0))), between))


def passages(rest: DataFrame) -> DataFrame:
    """Columns as of ``chunks``: neighbouring lines of which one has a word, and runs of blank lines with the line after.

    ``rest`` has the spans already removed in ``cuts_``; pieces inside one of them are left out.
    """
    rows = _rows(rest, "cuts_")
    n = F.size("lines")
    rows = rows.withColumn("stops", F.concat(F.array(F.lit(0)), "worded", F.array(n + 1)))
    cut = F.transform(
        "cuts_", lambda c: F.filter(F.sequence(c["first"], c["last"]), lambda i: F.get("lines", i - 1).rlike(WORD))
    )
    rows = rows.withColumn("cut_stops", F.coalesce(cut, F.array().cast("array<array<int>>")))
    known = F.flatten(F.transform("cut_stops", _pieces))
    rows = rows.withColumn("codes", F.array_except(_pieces(F.col("stops")), known))
    spans = F.transform(
        "codes",
        lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("first"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("last")),
    )
    return _cut_out(rows, F.filter(spans, lambda s: (s["first"] >= 1) & (s["last"] <= n)))


def _cut_out(rows: DataFrame, spans: Column) -> DataFrame:
    rows = rows.select("doc_id", "text_digest", "lines", F.inline(spans))
    chunk = F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    return rows.select("doc_id", "text_digest", "first", "last", chunk.alias("chunk"))


def repeated(docs: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``doc_id, text_digest, first, last`` of every chunk (as ``cut`` makes them) to remove."""
    key = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_digest", "first")
    found = cut(docs).withColumn("digest", F.xxhash64("chunk"))
    found = found.withColumn("place", key)
    # By digest, without the bytes: which can repeat at all. Full copies of a row have one place.
    twice = found.groupBy("digest").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("digest")
    twice = staged(twice, "repeated-digests")
    again = maybe_in(cut(docs).withColumn("digest", F.xxhash64("chunk")), "digest", bit_map(twice, "digest"))
    again = staged(again.join(twice, "digest", "left_semi").withColumn("place", key), "repeated-chunks")
    # By their bytes: the first place of each chunk that does repeat.
    firsts = again.groupBy("digest", "chunk").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b")
    firsts = firsts.withColumnRenamed("chunk", "same").withColumnRenamed("digest", "known")
    met = again.join(firsts, (F.col("digest") == F.col("known")) & (F.col("chunk") == F.col("same")))
    within = F.col("doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("text_digest") == F.col("a.text_digest"))
    met = met.where((F.col("place") != F.col("a")) & ~(within & (F.col("first") <= F.col("a.first") + F.col("last") - F.col("first"))))
    return met.select("doc_id", "text_digest", "first", "last").distinct()


def _with_spans(rows: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``rows`` with the spans of their text as a list, at most the pieces of one text; null where there are none."""
    own = spans.groupBy("doc_id", "text_digest").agg(F.collect_list(F.struct("first", "last")).alias(name))
    own = own.withColumnsRenamed({"doc_id": "own_id_", "text_digest": "own_digest_"})
    same = F.col("doc_id").eqNullSafe(F.col("own_id_")) & (F.md5("text") == F.col("own_digest_"))
    return rows.join(own, same, "left").drop("own_id_", "own_digest_")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with what is repeated cut out of ``text``, and ``n_lines``, ``n_removed`` (lines)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "text")]
    rows = docs.select("doc_id", "text", F.struct(*columns).alias("row_"))
    rest = staged(_with_spans(rows, repeated(docs, chunks), "cuts_"), "texts-and-chunks")
    made = _with_spans(rest, repeated(rest, passages), "pieces_")
    none = F.array().cast("array<struct<first:int,last:int>>")
    spans = F.concat(F.coalesce("cuts_", none), F.coalesce("pieces_", none))
    gone = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))
    made = made.withColumn("gone_", gone).withColumn("lines_", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(1), F.size("lines_")), F.col("gone_"))
    text = F.array_join(F.transform(left, lambda i: F.get("lines_", i - 1)), "\n")
    text = F.when(F.size("gone_") > 0, text).otherwise(F.col("text")).alias("text")
    return made.select(
        *[text if c == "text" else F.col("row_").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines_")).cast("long").alias("n_lines"),
        F.size("gone_").cast("long").alias("n_removed"),
    )


@columns_apart
def drop_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; ``n_chars`` follows the text, and documents left without a word go."""
    made = dedup(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    made = made.where(~emptied | F.col("text").isNull())
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)
