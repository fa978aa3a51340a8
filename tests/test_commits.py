"""Tables of commits: versions, deltas, several writers, cleanup."""

import pytest
from pyspark.sql import functions as F

from feedtide.session import folder_bytes, put_if_absent, read_text
from feedtide.sinks import commits, tables

KEYS = ("k",)


def _rows(spark, values):
    return spark.createDataFrame([(k, v) for k, v in values.items()], "k string, v long")


def _table(df):
    return {r.k: r.v for r in df.collect()}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def test_entries_are_put_once(spark, path):
    assert put_if_absent(spark, f"{path}/_log/1.json", "first")
    assert not put_if_absent(spark, f"{path}/_log/1.json", "second")
    assert read_text(spark, f"{path}/_log/1.json") == "first"


def test_versions(spark, path):
    with pytest.raises(FileNotFoundError):
        commits.read(spark, path)
    first = commits.replace(_rows(spark, {"a": 1}), path, KEYS)
    second = commits.replace(commits.read(spark, path).withColumn("v", F.col("v") + 1), path, KEYS)
    assert (first.number, second.number) == (1, 2)
    assert _table(commits.read(spark, path)) == {"a": 2}
    assert _table(commits.read(spark, path, 1)) == {"a": 1}


@pytest.mark.parametrize("both", [True, False])
def test_interleaved_writers_lose_nothing(spark, path, monkeypatch, both):
    """A second writer commits between a first one's look at the log and its entry."""
    commits.replace(_rows(spark, {"a": 1, "b": 1, "c": 1}), path, KEYS)
    put, others = commits.put_if_absent, []

    def late(spark_, entry, text):
        if not others:
            others.append(1)
            commits.upsert(_rows(spark, {"b": 2}), path, KEYS, compact_at=None)
            if both:
                commits.clean(spark, path, 3600.0)  # must not touch the folder that is about to be named
                commits.replace(_rows(spark, {"a": 9, "d": 9}), path, KEYS)
        return put(spark_, entry, text)

    monkeypatch.setattr(commits, "put_if_absent", late)
    new = commits.upsert(_rows(spark, {"a": 3}), path, KEYS, compact_at=None)
    want = {"a": 3, "d": 9} if both else {"a": 3, "b": 2, "c": 1}
    assert _table(commits.read(spark, path)) == want
    assert new.number == (4 if both else 3)
    assert [commits.version(spark, path, n).number for n in range(1, new.number + 1)] == list(range(1, new.number + 1))


def test_updates_are_computed_anew_after_a_conflict(spark, path, monkeypatch):
    commits.replace(_rows(spark, {"a": 1, "b": 1}), path, KEYS)
    seen = []

    def grown(rows):
        if not seen:
            seen.append(1)
            commits.upsert(_rows(spark, {"a": 10}), path, KEYS, compact_at=None)
        return rows.withColumn("v", F.col("v") + 1)

    commits.update(path, spark, KEYS, grown, compact_at=None)
    assert _table(commits.read(spark, path)) == {"a": 11, "b": 2}


def test_deltas_and_compaction(spark, path):
    commits.upsert(_rows(spark, {"a": 1, "b": 1}), path, KEYS, compact_at=None)  # no base yet
    commits.upsert(_rows(spark, {"b": 2, "c": 2}), path, KEYS, compact_at=None)
    gone = spark.createDataFrame([("a", 0, True), ("new", 0, True)], "k string, v long, _gone boolean")
    commits.upsert(gone, path, KEYS, compact_at=None)
    commits.upsert(_rows(spark, {"a": 5}).withColumn("extra", F.lit("x")), path, KEYS, compact_at=None)
    before = {(r.k, r.v, r.extra) for r in commits.read(spark, path).collect()}
    assert before == {("a", 5, "x"), ("b", 2, None), ("c", 2, None)}
    assert len(commits.version(spark, path).deltas) == 4
    folded = commits.compact(spark, path)
    assert not folded.deltas and {(r.k, r.v, r.extra) for r in commits.read(spark, path).collect()} == before
    assert commits.compact(spark, path) == folded
    commits.upsert(_rows(spark, {"b": 7}), path, KEYS, compact_at=0.0)
    assert not commits.version(spark, path).deltas and _table(commits.read(spark, path))["b"] == 7
    with pytest.raises(ValueError):
        commits.upsert(_rows(spark, {"b": 7}), path, ("v",))


def test_deltas_that_come_while_compacting_stay(spark, path, monkeypatch):
    commits.replace(_rows(spark, {"a": 1, "b": 1}), path, KEYS)
    commits.upsert(_rows(spark, {"a": 2}), path, KEYS, compact_at=None)
    write = commits._write

    def slow(rows, where, kind):
        name = write(rows, where, kind)
        if kind == "base":
            commits.upsert(_rows(spark, {"b": 3}), path, KEYS, compact_at=None)
        return name

    monkeypatch.setattr(commits, "_write", slow)
    folded = commits.compact(spark, path)
    assert len(folded.deltas) == 1 and _table(commits.read(spark, path)) == {"a": 2, "b": 3}


def test_a_batch_counts_once(spark, path):
    for _ in range(2):
        commits.upsert(_rows(spark, {"a": 1}), path, KEYS, mark=("stream", 0), compact_at=None)
    assert len(commits.version(spark, path).deltas) == 1
    commits.upsert(_rows(spark, {"a": 2}), path, KEYS, mark=("stream", 1), compact_at=None)
    commits.upsert(_rows(spark, {"a": 3}), path, KEYS, mark=("stream", 0), compact_at=None)
    assert _table(commits.read(spark, path)) == {"a": 2}


def test_cleanup_by_age(spark, path, monkeypatch):
    for i in range(3):
        commits.replace(_rows(spark, {"a": i}), path, KEYS)
    assert commits.clean(spark, path, 3600.0) == []
    _rows(spark, {"x": 1}).write.parquet(f"{path}/base-of-a-failed-run")
    now = commits.time.time()
    monkeypatch.setattr(commits.time, "time", lambda: now + 7200)
    assert len(commits.clean(spark, path, 3600.0)) == 3  # two old versions and the failed run's folder
    assert _table(commits.read(spark, path)) == {"a": 2} and commits.version(spark, path).number == 3


def test_an_update_writes_what_it_changes(spark, path):
    n = 20_000
    targets = spark.range(n).select(
        F.lit("f").alias("feed_key"), F.concat(F.lit("u"), "id").alias("uri_key"), F.rand(1).alias("note"), F.lit(0.5).alias("trend_score")
    )
    tables.publish_targets(targets.repartition(2), path)
    scores = spark.range(n + 5).where("id % 100 = 0 or id >= 20000").select(
        F.lit("f").alias("feed_url"), F.concat(F.lit("u"), "id").alias("uri"), F.lit(1.5).alias("trend_score")
    )
    want = tables.merge_scores(commits.read(spark, path), scores).orderBy("uri_key").collect()
    tables.update_scores(scores.coalesce(1), path)
    new = commits.version(spark, path)
    assert len(new.deltas) == 1
    assert spark.read.parquet(f"{path}/{new.deltas[0]}").count() == n // 100
    assert folder_bytes(spark, f"{path}/{new.deltas[0]}") < 0.05 * folder_bytes(spark, f"{path}/{new.base}")
    columns = targets.columns
    assert commits.read(spark, path).select(columns).orderBy("uri_key").collect() == [r for r in want]
    tables.update_scores(scores, path)  # nothing changes any more
    commits.compact(spark, path)
    assert commits.read(spark, path).select(columns).orderBy("uri_key").collect() == want
