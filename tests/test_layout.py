"""Per-user tables: plans that read one bucket, and joins without a shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.operators import timeline, votes
from feedtide.sinks import layout

T0 = dt.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def co_located(spark):
    names = [*layout.CO_LOCATED, "spark.sql.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    layout.co_located(spark)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("by-user")
    made = [(f"u{i % 40}", f"d{i}", f"i{i % 7}", f"t{i}", (-1, 1, 7)[i % 3], T0 + dt.timedelta(hours=i % 5)) for i in range(400)]
    stored = spark.createDataFrame(made, schemas.VOTES)
    rows = [(f"u{i % 50}", "f", "rss", f"title {i}", f"i{i % 9}", T0 + dt.timedelta(hours=i % 4)) for i in range(600)]
    lines = spark.createDataFrame(rows, "user_id string, feed_uri string, item_type string, title string, uri string, dateTime timestamp")
    paths = str(base / "votes"), str(base / "lines")
    layout.write_by_user(stored, paths[0], ["uriCreatedAt"], buckets=8)
    layout.write_by_user(lines, paths[1], ["dateTime"], buckets=8)
    return stored, lines, paths


def test_one_bucket_is_read(spark, tables):
    stored, _, (path, _) = tables
    table = layout.open_by_user(spark, path)
    mine = layout.of_user(table, "u3")
    assert "SelectedBucketsCount: 1 out of 8" in _plan(mine)
    want = stored.where("user_id = 'u3'")
    assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect()))
    listed = votes.voted_list(table, "u3")
    assert "SelectedBucketsCount: 1 out of 8" in _plan(listed)
    assert [str(r) for r in listed.collect()] == [str(r) for r in votes.voted_list(stored, "u3").collect()]


def test_joins_by_user_shuffle_nothing(spark, tables):
    stored, lines, paths = tables
    met = timeline.with_votes(layout.open_by_user(spark, paths[1]), layout.open_by_user(spark, paths[0]))
    assert "Exchange" not in _plan(met)
    readers = stored.select("user_id").where("user_id < 'u2'").distinct()
    few = votes.for_user(layout.open_by_user(spark, paths[0]), readers)
    large, _, small = _plan(few).partition("\n   +- Sort")
    assert "Bucketed: true" in large and "Exchange" not in large and "Exchange" in small  # the readers are dealt out
    want = timeline.with_votes(lines, stored)
    assert sorted(map(str, met.collect())) == sorted(map(str, want.collect()))


def test_a_table_is_opened_anew(spark, tables):
    stored, _, (path, _) = tables
    spark.sql(f"DROP TABLE {layout._name(path)}")
    again = layout.open_by_user(spark, path)
    assert again.schema.names == stored.schema.names and again.count() == stored.count()
    assert "SelectedBucketsCount: 1 out of 8" in _plan(layout.of_user(again, "u3"))
    with pytest.raises(FileExistsError):
        layout.write_by_user(stored, path)
    assert again.groupBy("user_id").agg(F.count("*")).count() == 40
