"""Extendible hashing into shards of bounded size (operator 1), with DataFrame functions only.

A directory maps prefixes of a row's hash bits to shards. It starts with one shard for all rows; only shards beyond the
byte limit are split on their next bit, and so on until each fits. The directory is found from byte counts by prefix,
a few bits a round: each round looks only at rows whose shard is still too large, so rows are summed, never moved.

Defined results: the key of a row is its doc_id and text, so rows that share a doc_id part as well; null texts have
0 bytes; full copies of a row have one hash and no bit parts them, so they stay together, and their shard may exceed
the limit, as may that of one document larger than the limit (``over_limit`` is true). Other columns are carried by
``shard``; one named like a new column is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.session import staged

#: Bits of the hash: 15 hexadecimal digits, so that they fit a positive long.
BITS = 60
NEW = ("shard", "depth", "n_bytes", "over_limit")


def _hash():
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int, step: int = 8) -> DataFrame:
    """``depth, prefix, shard_bytes``: the shards of ``sizes`` (``h_, n_bytes``), each within ``limit`` if bits can do it."""
    found, left, depth = None, sizes.withColumn("prefix_", F.lit(0).cast("long")), 0
    while True:
        # The sums of this round: each prefix of ``step`` more bits, rolled up to its shorter prefixes.
        top = min(depth + step, BITS)
        fine = left.groupBy(F.shiftright("h_", BITS - top).alias("prefix")).agg(F.sum("n_bytes").alias("bytes_"))
        levels = F.explode(F.sequence(F.lit(depth), F.lit(top)))
        sums = (
            fine.select("prefix", "bytes_", levels.alias("depth"))
            .groupBy("depth", F.expr(f"shiftright(prefix, {top} - depth)").alias("prefix"))
            .agg(F.sum("bytes_").alias("shard_bytes"))
        )
        sums = staged(sums, "shard-sums")
        # A prefix is a shard if it fits and the one above it doesn't. At the last bit it is one in any case.
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        above = sums.where(F.col("shard_bytes") > limit).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above_")
        )
        new = sums.where(fits & (F.col("depth") > depth)).join(
            above, (sums.depth == above.depth) & (F.shiftright("prefix", 1) == F.col("above_")), "left_semi"
        )
        if depth == 0:
            new = new.unionByName(sums.where(fits & (F.col("depth") == 0)))
        found = new if found is None else found.unionByName(new)
        large = sums.where((F.col("depth") == top) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("large_"))
        if top == BITS or large.isEmpty():
            return found
        left = left.join(large, F.shiftright("h_", BITS - top) == F.col("large_"), "left_semi")
        depth = top


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """``docs`` with ``shard`` (its bits as text, "" for one shard of all), ``depth``, ``n_bytes`` and ``over_limit``.

    The directory has a row a shard. It is joined on (depth, prefix) of the depths in use, which are a handful; the
    engine broadcasts it while it is small and shuffles it otherwise.
    """
    rows = docs.drop(*NEW).withColumns(
        {"h_": _hash(), "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")}
    )
    sizes = staged(rows.select("h_", "n_bytes"), "shard-sizes")
    shards = staged(directory(sizes, limit), "shard-directory")
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect()) or [0]  # at most 61, mostly 3 or 4
    # A prefix led by a 1 bit names its depth as well. A row has a name at each depth in use; one of them is a shard.
    named = lambda depth, prefix: F.shiftleft(F.lit(1).cast("long"), depth).bitwiseOR(prefix)
    names = F.array(*[named(d, F.shiftright("h_", BITS - d)) for d in depths])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    shards = shards.select(
        F.expr("shiftleft(1L, depth) | prefix").alias("name_"),
        bits.alias("shard"),
        "depth",
        (F.col("shard_bytes") > limit).alias("over_limit"),
    )
    kept = [c for c in rows.columns if c not in ("h_", "n_bytes")]
    return (
        rows.withColumn("name_", F.explode(names)).join(shards, "name_").select(*kept, "shard", "depth", "n_bytes", "over_limit")
    )
