"""Checks that report rows instead of failing the run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.functions.text import path_key


def untitled_documents(docs: DataFrame) -> DataFrame:
    """Documents with a null title: no words, but still counted in the corpus size."""
    return docs.where(F.col("title").isNull()).select("uri", "feedUrl", F.lit("null_title").alias("reason"))


def key_collisions(values: DataFrame, column: str) -> DataFrame:
    """(path_key, n_values): path-safe keys shared by several different values."""
    return (
        values.select(column)
        .distinct()
        .groupBy(path_key(column).alias("path_key"))
        .agg(F.count(F.lit(1)).alias("n_values"))
        .where("n_values > 1")
    )
