"""Skew-safe joins give the plain join's rows, whatever counts as hot."""

import pytest
from pyspark.sql import functions as F

from feedtide.operators import skew
from feedtide.operators.skew import attach_per_key, hot_keys, salted_join


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def sides(spark):
    # A third of the rows share one key on the left, another key is hot on the right.
    left = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 17)).alias("k"),
        F.col("id").alias("l"),
    )
    right = spark.range(120).select(
        F.when(F.col("id") % 2 == 0, "k1").when(F.col("id") % 5 == 0, "hot")
        .otherwise(F.concat(F.lit("k"), F.col("id") % 19)).alias("k"),
        F.col("id").alias("r"),
    )
    return left, right


def sizes(frame):
    return frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("min_rows", [None, 1, 7, 50])
def test_salted_join(sides, min_rows):
    left, right = sides
    want = rows_of(left.join(right, "k").select("k", "l", "r"))
    one = salted_join(left, right, ["k"], [F.col("l")], sizes(left), "n", min_rows=min_rows)
    both = salted_join(
        left, right, ["k"], [F.col("l")], sizes(left), "n", [F.col("r")], sizes(right), min_rows=min_rows
    )
    assert rows_of(one.select("k", "l", "r")) == want
    assert rows_of(both.select("k", "l", "r")) == want
    outer = salted_join(left, right, ["k"], [F.col("l")], sizes(left), "n", how="left", min_rows=min_rows)
    assert outer.count() == left.join(right, "k", "left").count()


@pytest.mark.parametrize("min_rows", [None, 1, 50])
@pytest.mark.parametrize("stage", [True, False])
def test_attach_per_key(sides, min_rows, stage):
    left, _ = sides
    per_key = sizes(left)
    got = attach_per_key(left, per_key, ["k"], "n", min_rows, stage)
    assert rows_of(got.select("k", "l", "n")) == rows_of(left.join(per_key, "k").select("k", "l", "n"))


def test_hot_keys_are_few(sides):
    left, _ = sides
    assert [r.k for r in hot_keys(sizes(left), "n", 50).collect()] == ["hot"]


def test_right_salts_need_an_inner_join(sides):
    left, right = sides
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], [F.col("l")], sizes(left), "n", [F.col("r")], sizes(right), how="left")


def test_a_key_hot_on_both_sides_is_cut_by_what_it_makes(spark):
    """100 x 100 rows of one key, neither side large: with 500 rows a cell no task may make more than a few times that."""
    left = spark.range(100).select(F.lit("hot").alias("k"), F.col("id").alias("l"))
    right = spark.range(100).select(F.lit("hot").alias("k"), F.col("id").alias("r"))
    grid = skew._salt_grid(sizes(left), sizes(right), ["k"], "n", 500).first()
    assert grid["_left_salt"] * grid["_right_salt"] >= 20
    joined = salted_join(left, right, ["k"], [F.col("l")], sizes(left), "n", [F.col("r")], sizes(right), min_rows=500)
    assert joined.count() == 10_000
    cells = skew._salted(left, F.broadcast(grid_frame(spark, grid)), ["k"], "_left_salt", [F.col("l")])
    assert cells.groupBy("_left_salt").count().agg(F.max("count")).first()[0] <= 3 * 100 / grid["_left_salt"] + 5


def grid_frame(spark, grid):
    return spark.createDataFrame([("hot", grid["_left_salt"])], "k string, _left_salt int")
