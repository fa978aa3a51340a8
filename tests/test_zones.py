"""Tables cut by user and time: parts that a bound does not reach are never opened."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from feedtide import schemas
from feedtide.operators import timeline
from feedtide.sinks import zones

T0 = dt.datetime(2024, 1, 1)


def _votes(spark, n=600):
    rng = random.Random(5)
    rows = [
        (f"u{rng.randrange(12)}", f"d{i}", f"i{i % 9}", f"t{i}", 1, None if i % 50 == 0 else T0 + dt.timedelta(hours=rng.randrange(900)))
        for i in range(n)
    ]
    return spark.createDataFrame([*rows, *rows[:5]], schemas.VOTES)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows, path = _votes(spark), str(tmp_path_factory.mktemp("zones") / "votes")
    zones.write_by_zone(rows, path, "uriCreatedAt", buckets=4, zones=6, files_per_part=2)
    return rows, path


def test_all_rows_are_there(spark, stored):
    rows, path = stored
    assert _rows(zones.open_by_zone(spark, path)) == _rows(rows)
    index = zones.index(spark, path)
    assert index.agg(F.sum("n_rows")).first()[0] == rows.count()
    assert index.where("_zone = -1 and last is not null").count() == 0
    with pytest.raises(FileExistsError):
        zones.write_by_zone(rows, path, "uriCreatedAt")


def _bounds(spark, hours):
    users = [(f"u{i}", T0 + dt.timedelta(hours=hours)) for i in range(12)]
    return spark.createDataFrame(users, "user_id string, _oldest timestamp")


def test_fewer_parts_for_later_bounds(spark, stored):
    rows, path = stored
    counts = []
    for hours in (-1, 300, 700, 2000):
        bounds = _bounds(spark, hours)
        counts.append(zones.parts_since(spark, path, bounds, "_oldest").count())
        late = F.col("uriCreatedAt") >= F.lit(T0 + dt.timedelta(hours=hours))
        assert _rows(zones.since(spark, path, bounds, "_oldest").where(late)) == _rows(rows.where(late))
    assert counts == sorted(counts, reverse=True) and counts[0] == 24 and counts[1] > counts[2] > counts[3] == 0


def test_old_parts_are_not_opened(spark, tmp_path):
    rows, path = _votes(spark), str(tmp_path / "votes")
    zones.write_by_zone(rows, path, "uriCreatedAt", buckets=4, zones=6)
    feeds = spark.createDataFrame([(f"u{i}", "x", "rss", "feed", T0) for i in range(12)], schemas.FEED_URIS)
    items = spark.createDataFrame(
        [("feed", T0 + dt.timedelta(hours=h)) for h in (700, 800)], "feed_uri string, dateTime timestamp"
    )
    want = _rows(timeline.votes_since_oldest_item(feeds, items, rows))
    for part in glob.glob(f"{path}/data/_bucket=*/_zone=[0-2]/*.parquet"):
        with open(part, "wb") as file:
            file.write(b"not a table")
    spark.catalog.clearCache()
    got = timeline.stored_votes_since_oldest_item(feeds, items, path)
    assert _rows(got) == want and want


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    zones.write_by_zone(_votes(spark).where("false"), path, "uriCreatedAt", buckets=2, zones=2)
    assert zones.since(spark, path, _bounds(spark, 0), "_oldest").count() == 0
