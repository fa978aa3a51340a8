"""Mixing sources to target weights by capped water-filling (operator 13), with DataFrame functions only.

Sources share ``share`` times all words by their weights. A source stops at ``most`` times its own words; what it leaves
goes to the others by weight, round after round, until none is above. A round is one aggregate over the sources: the
state of the filling is a single number, the water level, since a source is clamped where level times weight is above
its cap. Levels only rise, so the rounds end.

A source takes each of its documents whole as often as its target holds the source, and fills the rest with a seeded
sample: its documents in the order of a hash, until the words are spent; the last one is taken in part, so that taken
words meet the target to half a word. The place where a source's words are spent is found by three aggregates over
ranges of the hash (4096 ranges, 4096 within one of them, then its documents), so no source is sorted in one task,
whatever share of the rows it holds. Full copies of a row share a place; there they are ranked by the files they were
written to, not in one group.

Defined results: a null text has size 0; the null source is a source and comes last; sources without words have target
0; without any words all targets are 0. Documents that share a doc_id are told apart by their texts, and full copies of
a row are taken one after another, so a repeated run gives the same rows. Input columns are carried inside ``row``, so
none can clash; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedtide.llm.common import WORD
from feedtide.operators.indexing import row_index
from feedtide.operators.skew import attach_per_key
from feedtide.session import staged

#: Sources that may be broadcast; more are joined by key, hot ones apart.
FEW_SOURCES = 10_000
_RANGE_BITS = 12


def _sized(docs: DataFrame, columns: Sequence[str], seed: str) -> DataFrame:
    """(key, row, size, h, h2, part, ord): every document's source, words, seeded place and file, written once."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    piece = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("long")
    rows = docs.select(
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("key"),
        F.struct(*columns).alias("row"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        digest.alias("digest"),
    )
    placed = rows.select("key", "row", "size", piece(1).alias("h"), piece(16).alias("h2"))
    numbered = placed.withColumns({"part": F.spark_partition_id(), "ord": F.monotonically_increasing_id()})
    return staged(numbered, "mix-rows")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which (weight, cap) sources hold ``total``: each the smaller of its cap and level times weight."""
    level = None
    while True:
        above = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        held = sources.agg(
            F.sum(F.when(above, F.col("cap"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")
        ).first()
        if not held.open:
            return level or 0.0
        new = (total - (held.full or 0.0)) / held.open
        if level is not None and new <= level:
            return level
        level = new


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(key, n_docs, source_size, target, whole, rest): words each source takes, and its whole rounds and words beyond.

    ``sizes`` is (key, n_docs, source_size); weights repeat over the keys in ascending order.
    """
    named = F.array(*[F.lit(w) for w in weights])
    at = F.pmod("place", F.lit(len(weights))).cast("int")
    known = staged(
        row_index(sizes, "key", "place").select(
            "key", "n_docs", "source_size", F.get(named, at).alias("weight"),
            (F.lit(float(most)) * F.col("source_size")).alias("cap"),
        ),
        "mix-sources",
    )
    words = known.agg(F.sum("source_size").alias("n")).first().n or 0
    level = water_level(known, share * words)
    target = F.least("cap", F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        known.select("key", "n_docs", "source_size", target.alias("target"))
        .withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    )


def _crossing(groups: DataFrame, *order: str) -> DataFrame:
    """Of each key's ``words`` in an order, the group in which ``rest`` is spent, with what is left of it there."""
    before = F.sum("words").over(Window.partitionBy("key").orderBy(*order)) - F.col("words")
    spent = groups.withColumn("before", before).where("before <= rest and rest < before + words")
    return spent.withColumn("rest", F.col("rest") - F.col("before")).drop("before", "words")


def mix(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """(row, size, source_size, target, taken) of every document; ``row`` holds the named input ``columns``.

    ``taken`` counts the words the mix takes of it: whole repetitions and, for one document of a source, a part.
    """
    rows = _sized(docs, columns, seed)
    sizes = staged(rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), "mix-sizes")
    few = sizes.count() <= FEW_SOURCES
    of_source = staged(targets(sizes, weights, share, most), "mix-targets")

    def attach(left: DataFrame, per_source: DataFrame) -> DataFrame:
        if few:
            return left.join(F.broadcast(per_source), "key")
        return attach_per_key(left, per_source, ["key"], "n_docs")

    left = F.shiftright("h", 60 - _RANGE_BITS)
    second = F.shiftright("h", 60 - 2 * _RANGE_BITS).bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    wordy = rows.where("size > 0").select("key", "size", "h", "h2", left.alias("b1"), second.alias("b2"))
    goal = of_source.select("key", "n_docs", "rest")
    first = wordy.groupBy("key", "b1").agg(F.sum("size").alias("words")).join(goal, "key")
    first = staged(_crossing(first, "b1").withColumnRenamed("b1", "c1"), "mix-range")
    within = attach(wordy, first).where("b1 = c1")
    second_ranges = within.groupBy("key", "n_docs", "rest", "c1", "b2").agg(F.sum("size").alias("words"))
    found = staged(_crossing(second_ranges, "b2").withColumnRenamed("b2", "c2"), "mix-range")
    near = attach(wordy, found).where("b1 = c1 and b2 = c2")
    items = near.groupBy("key", "rest", "h", "h2").agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
    cut = _crossing(items, "h", "h2").select(
        "key", F.col("rest").alias("cut_rest"), F.col("h").alias("cut_h"), F.col("h2").alias("cut_h2"), "copies"
    )
    plan = staged(of_source.join(cut, "key", "left"), "mix-plan")

    planned = attach(rows, plan)
    at_cut = F.coalesce((F.col("h") == F.col("cut_h")) & (F.col("h2") == F.col("cut_h2")) & (F.col("size") > 0), F.lit(False))
    tied = at_cut & (F.col("copies") > 1)
    beyond = F.struct("h", "h2") > F.struct("cut_h", "cut_h2")
    alone = planned.where(~tied).withColumn(
        "extra", F.when(at_cut, F.col("cut_rest")).when(beyond & F.col("cut_h").isNotNull(), 0).otherwise(F.col("size"))
    )
    # Copies at the cut: numbered within the file they were written to, after the copies of the files before.
    copies = planned.where(tied)
    counts = copies.groupBy("key", "part").agg(F.count("*").alias("in_part"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "part").orderBy("ord")) - 1
    ranked = copies.withColumn("rank", rank).join(counts, ["key", "part"])
    spent = F.col("cut_rest") - (F.col("before") + F.col("rank")) * F.col("size")
    ranked = ranked.withColumn("extra", F.least(F.greatest(spent, F.lit(0)), F.col("size")))
    every = alone.unionByName(ranked.select(*alone.columns))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return every.select("row", "size", "source_size", "target", taken.alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, with the white space before each."""
    words = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), n), "")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of ``docs`` as often as they are taken, the last repetition cut to its share of words.

    Documents of which the mix takes no word are not in it.
    """
    made = mix(docs, docs.columns, **options).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    repeated = made.withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    left = (F.col("taken") - (F.col("time") - 1) * F.col("size")).cast("int")
    part = F.when(left < F.col("size"), _first_words(F.col("row.text"), left)).otherwise(F.col("row.text"))
    return repeated.select(*[part.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
