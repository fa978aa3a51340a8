"""Vote actions as a stream, folded in Spark's keyed state.

The state after a history depends on its trailing run of equal actions only (``operators.votes``), so that run is all a
key has to keep: its sign, its places in time, and the place of the last action against it, the cut. An action from
before the cut can never count again, whenever it arrives. One of the run's sign joins the run; one against it that is
newer than all of it starts a new run; one against it that falls inside the run moves the cut there. So actions may come
in any order, and the stream ends where a batch over the whole history does.

State lives in Spark's state store (RocksDB): one short value per key, with the places of a short run. Those of a long run
are appended to a list, which is read only when a late action cuts the run, and streamed through, so a run may have any
length. A batch
reads nothing but its own actions. Its changed keys become a keyed delta of the table of runs (``sinks.commits``),
committed once per batch, and compacted there. What a run makes of the vote a user started from is told when the table
is read: an even run withdraws, and the first run of a history counts the stored vote of its sign as one press.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from feedtide.operators.votes import KEY, one_vote_per_key, valid_actions, with_states
from feedtide.sinks import commits

RUNS = (
    "user_id string, uri string, uriCreatedAt timestamp, title string, sign int, run long, whole boolean, "
    "ts timestamp, event_id long, late long"
)
_FOLDED = "user_id string, uri string, made long, title string, sign int, run long, whole boolean, at long, event_id long, late long"
_HEAD = (
    "sign int, run long, cut_at long, cut_id long, last_at long, last_id long, title string, late long, side int, near array<long>"
)
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; a query keeps the settings it was started with."""
    before = {name: spark.conf.get(name, None) for name in _STORE}
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _trailing_runs(inline: int, chunk: int) -> StatefulProcessor:
    """The keyed fold. Runs beyond ``inline`` places go to a list, of which at most ``chunk`` are in memory."""

    class TrailingRuns(StatefulProcessor):
        def init(self, handle):
            self.head = handle.getValueState("head", _HEAD)
            # A long run's places are in one of two lists; a cut copies what is left of them to the other.
            self.sides = [handle.getListState(name, "at long, event_id long") for name in ("even", "odd")]

        def close(self):
            pass

        def handleInputRows(self, key, rows, timerValues):
            head = self.head.get()
            sign, run, cut, last, title, late, side, places = 0, 0, None, None, None, 0, -1, []
            if head is not None:
                sign, run, cut_at, cut_id, last_at, last_id, title, late, side, near = head
                cut, last = None if cut_at is None else (cut_at, cut_id), (last_at, last_id)
                places = list(zip(near[::2], near[1::2]))
            known, moved = last, False  # moved: places in a list may lie before the cut
            for row in rows:
                place = (row.at, row.event_id)
                late += known is not None and place <= known
                if row.title is not None and (title is None or row.title < title):
                    title = row.title
                if not sign or place > last and row.sign != sign:
                    if side >= 0:
                        self.sides[side].clear()
                    sign, run, cut, last, side, places, moved = row.sign, 1, last, place, -1, [place], False
                elif cut is not None and place <= cut:
                    continue
                elif row.sign == sign:
                    run, last = run + 1, max(last, place)
                    places.append(place)
                else:
                    cut, moved = place, side >= 0
                    places = [p for p in places if p > cut]
                    run = len(places)  # and what a list gives
                if len(places) >= chunk:
                    side = self._spill(side, places)
            if moved:
                spare, part, run = 1 - side, [], len(places)
                for stored in self.sides[side].get():
                    if tuple(stored) > cut:
                        part.append(tuple(stored))
                        run += 1
                    if len(part) >= chunk:
                        self.sides[spare].appendList(part)
                        part = []
                self.sides[side].clear()
                side = spare
                places += part
            if places and (side >= 0 or len(places) > inline):
                side = self._spill(side, places)
            cut_at, cut_id = cut or (None, None)
            near = [n for p in places for n in p]
            self.head.update((sign, run, cut_at, cut_id, *last, title, late, side, near))
            yield Row(
                user_id=key[0], uri=key[1], made=key[2], title=title, sign=sign, run=run, whole=cut is None,
                at=last[0], event_id=last[1], late=late,
            )

        def _spill(self, side, places):
            side = max(side, 0)
            self.sides[side].appendList(list(places))
            places.clear()
            return side

    return TrailingRuns()


def trailing_runs(actions: DataFrame, inline: int = 32, chunk: int = 10_000) -> DataFrame:
    """The changed keys of every batch of a stream of actions, with their trailing run (columns ``RUNS``)."""
    rows = valid_actions(actions).select(
        "user_id", "uri", F.unix_micros("uriCreatedAt").alias("made"), "title", F.unix_micros("ts").alias("at"), "event_id", "sign"
    )
    folded = rows.groupBy("user_id", "uri", "made").transformWithState(
        statefulProcessor=_trailing_runs(inline, chunk), outputStructType=_FOLDED, outputMode="Update", timeMode="None"
    )
    return folded.select(
        "user_id", "uri", F.timestamp_micros("made").alias("uriCreatedAt"), "title", "sign", "run", "whole",
        F.timestamp_micros("at").alias("ts"), "event_id", "late",
    )


def start_vote_log(actions: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Fold a stream of actions into the table of runs at ``path``, then stop. ``options`` are ``trailing_runs``'s."""
    spark = actions.sparkSession

    def publish(batch: DataFrame, batch_id: int) -> None:
        commits.upsert(batch, path, KEY, mark=(checkpoint, batch_id))

    with state_in_rocksdb(spark):
        return (
            trailing_runs(actions, **options)
            .writeStream.foreachBatch(publish)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def change_log(spark, path: str) -> DataFrame:
    """One row a key that had an action: title, trailing run, its last place, and how many of its actions came late."""
    return commits.read(spark, path)


def run_states(runs: DataFrame, votes: DataFrame) -> DataFrame:
    """(key, title, old_state, state) of every key of a table of runs, on top of the stored votes."""
    starts = one_vote_per_key(votes).select(*KEY, F.col("state").alias("_stored"))
    known = runs.join(starts, list(KEY), "left").withColumn("old_state", F.coalesce("_stored", F.lit(0)))
    presses = F.col("run") + (F.col("whole") & (F.col("old_state") == F.col("sign"))).cast("int")
    state = F.when(F.col("run") == 0, F.col("old_state")).when(presses % 2 == 1, F.col("sign")).otherwise(0)
    return known.select(*KEY, "title", "old_state", state.cast("int").alias("state"))


def current_votes(runs: DataFrame, votes: DataFrame) -> DataFrame:
    """The vote table after a stream, on top of the table it started from."""
    return with_states(votes, run_states(runs.where("run > 0"), votes))
