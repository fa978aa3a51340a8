"""Connected components of a link table, as a few joins and aggregates a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.session import staged


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``links`` (``a``, ``b``: longs).

    Every round ties all neighbours of a node to the smallest of them, first those that are larger than the node, then
    the others, until each node hangs on the smallest of its component. Rounds grow with the logarithm of the number of
    nodes. Nothing is collected but two numbers a round that tell whether a round changed anything.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Larger neighbours go to the smallest; with links stored both ways that is every larger one of each node.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "edges")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = lows.select("u", F.col("m").alias("v"))
        edges = staged(small.unionByName(own).where("u <> v").distinct(), "edges")
