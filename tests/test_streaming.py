"""Streams give what the batch operators give."""

import datetime as dt
import random

import pytest

from feedtide import schemas
from feedtide.operators import timeline, votes
from feedtide.sources import feeds
from feedtide.sinks import commits
from feedtide.streaming import ingest, timeline as live, votes as vote_stream
from feedtide.streaming.timeline import add_changes, current_timelines, start_live_timelines

T0 = dt.datetime(2024, 1, 1)


def document(n):
    items = "".join(f"<item><title>t{i}</title><link>http://x/{i}</link></item>" for i in range(n))
    return (
        '<rss xmlns:atom="a"><channel><atom:link rel="self" href="http://x"/>' + items
        + "<item><title>lost</title></item></channel></rss>"
    )


def test_ingest_runs_twice(spark, tmp_path):
    landed, table, marks = (str(tmp_path / n) for n in ("landed", "entries", "marks"))
    for day, n in enumerate((3, 5)):
        row = [
            ("feed", document(n), T0 + dt.timedelta(days=day)),
            ("broken", "<rss><channel>", T0 + dt.timedelta(days=day)),
        ]
        spark.createDataFrame(row, schemas.RAW_FEEDS).write.mode("append").parquet(landed)
        ingest.refresh(spark, landed, table, marks)
    late = [("feed", document(1).replace("<title>t0", "<title>changed"), T0 - dt.timedelta(days=400))]
    spark.createDataFrame(late, schemas.RAW_FEEDS).write.mode("append").parquet(landed)
    ingest.refresh(spark, landed, table, marks)
    got = ingest.ingested_items(spark, table)
    batch = feeds.rss_items(spark.read.parquet(landed))
    assert got.count() == 9 and got.where("title = 'changed'").count() == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    rejects = ingest.rejected_entries(spark, table)
    assert sorted((r.uri, r.title, r.reason) for r in rejects.fillna("-").collect()) == [
        ("broken", "-", "malformed_xml"), ("broken", "-", "malformed_xml"), *[("feed", "lost", "missing_link")] * 3,
    ]
    ingest.refresh(spark, landed, table, marks)
    assert ingest.ingested_items(spark, table).count() == 9


def test_ingest_without_repeats(spark, tmp_path):
    landed, table, marks = (str(tmp_path / n) for n in ("landed", "entries", "marks"))
    edited = document(2).replace("<title>t1", "<title>edited")
    batches = [
        [("a", document(3)), ("a", document(3)), ("b", document(1)), ("broken", "<rss><channel>")],
        [("a", document(3)), ("broken", "<rss><channel>")],
        [("a", edited), ("a", document(4))],
    ]
    counts = []
    for day, rows in enumerate(batches):  # the last one is older than all others
        at = T0 + dt.timedelta(days=day if day < 2 else -400)
        spark.createDataFrame([(*r, at) for r in rows], schemas.RAW_FEEDS).write.mode("append").parquet(landed)
        ingest.refresh(spark, landed, table, marks, repeats=False)
        counts.append(ingest.ingested_items(spark, table).count())
    assert counts == [4, 4, 6]
    assert ingest.ingested_items(spark, table).where("title = 'edited'").count() == 1
    rejects = ingest.rejected_entries(spark, table)
    assert sorted(r.uri for r in rejects.collect()) == ["a", "b", "broken"]


@pytest.mark.parametrize("options", [{}, {"inline": 1, "chunk": 2}])
def test_votes_stream_equals_batch(spark, tmp_path, options):
    rng = random.Random(7)
    rows = [
        (f"u{rng.randrange(3)}", f"i{rng.randrange(4)}", "t", T0, rng.choice(["up", "up", "up", "up", "down", "?"]),
         T0 + dt.timedelta(seconds=n // 3), n)
        for n in range(300)
    ]
    log, source, marks = (str(tmp_path / n) for n in ("log", "actions", "marks"))
    stored = [(f"u{i}", f"d{i}{k}", f"i{i}", "stored", state, T0) for i in range(3) for k, state in enumerate((1, -1, 7))]
    table = spark.createDataFrame(stored, schemas.VOTES)
    rng.shuffle(rows)  # later batches bring actions from before earlier ones
    late = 0
    for upto in (100, 220, 300):
        part = rows[late:upto]
        late = upto
        spark.createDataFrame(part, schemas.VOTE_ACTIONS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.VOTE_ACTIONS).parquet(source)
        vote_stream.start_vote_log(stream, log, marks, **options).awaitTermination()
        got = vote_stream.current_votes(vote_stream.change_log(spark, log), table)
        want = votes.apply_votes(table, spark.createDataFrame(rows[:upto], schemas.VOTE_ACTIONS))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert vote_stream.change_log(spark, log).agg({"late": "sum"}).first()[0] > 50
    assert {r.doc_id for r in got.collect()} >= {"d01", "d02", "d11", "d12", "d21", "d22"}


def test_live_timelines(spark, tmp_path):
    """New items reach old subscribers, and new subscribers old items; a batch tried again adds nothing."""
    item = lambda feed, n: (f"f{feed}", feeds.RSS, f"t{n}", f"http://{n}", T0 + dt.timedelta(hours=n))
    steps = [
        ([("u", "1", None, "f0", T0), ("v", "2", None, "f1", T0)], [item(0, 0), item(2, 1)]),
        ([("u", "3", None, "f2", T0), ("w", "4", None, None, T0)], []),
        ([], [item(1, 2), item(0, 3), ("f0", feeds.RSS, "untimed", "http://x", None)]),
        ([("v", "5", None, "f0", T0), ("u", "1", None, "f0", T0)], [item(0, 4)]),
    ]
    subs, items, view, marks = (str(tmp_path / n) for n in ("subs", "items", "view", "marks"))
    spark.createDataFrame([], schemas.FEED_URIS).write.parquet(subs)
    spark.createDataFrame([], schemas.FEED_ITEMS).write.parquet(items)
    for new_subs, new_items in steps:
        spark.createDataFrame(new_subs, schemas.FEED_URIS).coalesce(1).write.mode("append").parquet(subs)
        spark.createDataFrame(new_items, schemas.FEED_ITEMS).coalesce(1).write.mode("append").parquet(items)
        start_live_timelines(spark, subs, items, view, marks).awaitTermination()
        got = current_timelines(spark, view)
        want = timeline.user_items(spark.read.parquet(subs), spark.read.parquet(items))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    rows = got.count()
    assert rows == 11
    last = spark.createDataFrame(steps[-1][0], schemas.FEED_URIS), spark.createDataFrame(steps[-1][1], schemas.FEED_ITEMS)
    done = commits.version(spark, f"{view}/view").marks[marks]
    add_changes(*last, view, (marks, done))
    assert current_timelines(spark, view).count() == rows
    mine = current_timelines(spark, view, "v")
    assert {r.user_id for r in mine.collect()} == {"v"} and mine.count() == 4
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_slot" in plan  # one slot of users is read


def test_a_batch_reads_the_slots_it_touches(spark, tmp_path):
    view = str(tmp_path / "view")
    subs = spark.createDataFrame([(f"u{i}", str(i), None, f"f{i}", T0) for i in range(200)], schemas.FEED_URIS)
    items = spark.createDataFrame([(f"f{i}", feeds.RSS, "t", f"http://{i}", T0) for i in range(200)], schemas.FEED_ITEMS)
    add_changes(subs, items, view, ("m", 0))
    one = spark.createDataFrame([("f7", feeds.RSS, "new", "http://new", T0)], schemas.FEED_ITEMS)
    slots = [r[0] for r in one.select(commits.slot("feed_uri")).collect()]
    known = live._known(spark, f"{view}/subscriptions", subs, slots)
    assert 0 < len(known.inputFiles()) and known.count() < 20
    add_changes(subs.limit(0), one, view, ("m", 1))
    assert current_timelines(spark, view, "u7").count() == 2 and current_timelines(spark, view).count() == 201
    for batch in range(2, 5):
        commits.append(commits.read(spark, f"{view}/items").limit(0), f"{view}/items", ("m", batch), most_parts=3)
    assert len(commits.version(spark, f"{view}/items").parts) <= 3 and commits.read(spark, f"{view}/items").count() == 201
