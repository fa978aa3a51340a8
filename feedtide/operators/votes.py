"""Up/down votes: the state machine in closed form, and the vote table.

State of an item for a user is -1, 0 or 1. Pressing the button of the current
sign withdraws the vote, any other press sets that sign. So the state after a
history depends only on its trailing run of equal actions: with run length k
(plus one if the run is the whole history and the starting state already has its
sign) the state is the sign for odd k and 0 for even k. That needs two mergeable
aggregates and no ordering of rows in one place, so a key with any number of
actions is no burden to a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.operators.skew import attach_per_key

KEY = ("user_id", "uri", "uriCreatedAt")


def polarity(state: Column) -> Column:
    """-1, 0 or 1 by the sign of a stored state."""
    return F.signum(state).cast("int")


def action_sign(action: Column) -> Column:
    """+1 for "up", -1 for "down", null for anything else."""
    return F.when(action == "up", 1).when(action == "down", -1)


def _keyed(key) -> Column:
    known = F.lit(True)
    for name in key:
        known = known & F.col(name).isNotNull()
    return known


def invalid_actions(actions: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Actions that are neither up nor down, lack their place in time, or name no item."""
    reason = (
        F.when(action_sign(F.col("action")).isNull(), "unknown_action")
        .when(F.col("ts").isNull() | F.col("event_id").isNull(), "no_order")
        .when(~_keyed(key), "no_key")
    )
    return actions.withColumn("reason", reason).where(F.col("reason").isNotNull())


def invalid_votes(votes: DataFrame) -> DataFrame:
    """Stored votes with a state no transition knows; they are not applied."""
    return votes.where(~F.coalesce(F.col("state").isin(-1, 0, 1), F.lit(False))).withColumn(
        "reason", F.lit("unknown_state")
    )


def valid_actions(actions: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, title, ts, event_id, sign) of the actions that count."""
    return actions.select(
        *key, "title", "ts", "event_id", action_sign(F.col("action")).alias("sign")
    ).where(F.expr("sign is not null and ts is not null and event_id is not null") & _keyed(key))


def folded_states(
    rows: DataFrame,
    starts: DataFrame | None = None,
    key: tuple[str, ...] = KEY,
    min_hot_rows: int | None = None,
) -> DataFrame:
    """(key, old_state, state, ts, event_id): signed actions folded into starting states.

    ``rows`` is ``valid_actions``, ``starts`` has at most one (key, old_state) row
    per key; a key without one starts at 0. ts and event_id are the last action's.
    """
    key = list(key)
    place = F.struct("ts", "event_id")
    last = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.max(F.when(F.col("sign") > 0, place)).alias("last_up"),
        F.max(F.when(F.col("sign") < 0, place)).alias("last_down"),
    )
    up_is_last = F.coalesce(
        F.col("last_down").isNull() | (F.col("last_up") > F.col("last_down")), F.lit(False)
    )
    last = last.select(
        *key,
        "n_actions",
        F.when(up_is_last, 1).otherwise(-1).alias("last_sign"),
        F.when(up_is_last, F.col("last_up")).otherwise(F.col("last_down")).alias("last_place"),
        F.when(up_is_last, F.col("last_down")).otherwise(F.col("last_up")).alias("cut"),
    )
    runs = (
        attach_per_key(rows, last, key, "n_actions", min_hot_rows)
        .where(F.col("cut").isNull() | (place > F.col("cut")))
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("run"),
            F.first("last_sign").alias("last_sign"),
            F.first("last_place").alias("last_place"),
            F.first("cut").isNull().alias("whole"),
        )
    )
    if starts is None:
        started = runs.withColumn("old_state", F.lit(0))
    else:
        started = runs.join(starts, key, "left").withColumn("old_state", F.coalesce("old_state", F.lit(0)))
    head_start = (F.col("whole") & (F.col("old_state") == F.col("last_sign"))).cast("int")
    return started.select(
        *key,
        F.col("old_state").cast("int").alias("old_state"),
        F.when((F.col("run") + head_start) % 2 == 1, F.col("last_sign")).otherwise(0).alias("state"),
        "last_place.*",
    )


def vote_states(
    actions: DataFrame,
    votes: DataFrame | None = None,
    key: tuple[str, ...] = KEY,
    min_hot_rows: int | None = None,
) -> DataFrame:
    """(key, old_state, state) of every key with a valid action.

    Actions are ordered by (ts, event_id). ``votes`` holds the starting states; a
    key without a row starts at 0.
    """
    starts = None
    if votes is not None:
        starts = one_vote_per_key(votes, key).select(*key, F.col("state").alias("old_state"))
    return folded_states(valid_actions(actions, key), starts, key, min_hot_rows).drop("ts", "event_id")


def one_vote_per_key(votes: DataFrame, key: tuple[str, ...] | list[str] = KEY) -> DataFrame:
    """Valid stored votes reduced to one per key, the smallest doc_id."""
    key = list(key)
    rest = [c for c in votes.columns if c not in key and c != "doc_id"]
    valid = votes.where(F.col("state").isin(-1, 0, 1))
    return (
        valid.groupBy(*key)
        .agg(F.min_by(F.struct("doc_id", *rest), F.col("doc_id")).alias("_v"))
        .select(*key, "_v.*")
    )


def vote_changes(states: DataFrame) -> DataFrame:
    """Add the change each new state asks of the vote table; unchanged keys are left out."""
    old, new = F.col("old_state"), F.col("state")
    return states.where(old != new).withColumn(
        "change", F.when(old == 0, "insert").when(new == 0, "delete").otherwise("update")
    )


def new_vote_id(key: tuple[str, ...] | list[str] = KEY) -> Column:
    """The doc_id of an inserted vote: a hash of its key, so that a repeated run gives the same table."""
    return F.sha2(F.concat_ws("\u0001", *key), 256)


def with_states(votes: DataFrame, states: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The vote table after ``states`` (key, state, title), one row per key that had an action.

    A key's actions address its one vote (``one_vote_per_key``): that document gets the
    new state and keeps title and doc_id, or goes if the state is 0. A key without one
    gets a new document unless its state is 0. All other documents stay as they are:
    further votes on the same key, and votes in a state no transition knows.
    """
    names = list(key)
    columns = ["user_id", "doc_id", "uri", "title", "state", "uriCreatedAt"]
    addressed = one_vote_per_key(votes, key).select(*names, "doc_id")
    told = states.select(*names, F.col("state").alias("_state"), F.col("title").alias("_title"))
    changes = addressed.join(told, names).select("user_id", "doc_id", "_state")
    kept = votes.join(changes, ["user_id", "doc_id"], "left").where("_state is null or _state != 0")
    kept = kept.withColumn("state", F.coalesce("_state", "state")).select(*columns)
    added = told.where("_state != 0").join(addressed, names, "left_anti")
    added = added.withColumn("doc_id", new_vote_id(key)).withColumnsRenamed({"_state": "state", "_title": "title"})
    return kept.unionByName(added.select(*columns))


def apply_votes(
    votes: DataFrame, actions: DataFrame, key: tuple[str, ...] = KEY, min_hot_rows: int | None = None
) -> DataFrame:
    """New version of the vote table after a history of actions (see ``with_states``)."""
    names = list(key)
    states = vote_states(actions, votes, key, min_hot_rows).select(*names, "state")
    titles = valid_actions(actions, key).groupBy(*names).agg(F.min("title").alias("title"))
    return with_states(votes, states.join(titles, names), key)


def voted_list(votes: DataFrame, readers: str | DataFrame) -> DataFrame:
    """Votes in order of item time: those of one reader, or of each of a table of readers (``user_id``) in turn."""
    return for_user(votes, readers).orderBy("user_id", "uriCreatedAt", "doc_id")


def for_user(rows: DataFrame, readers: str | DataFrame) -> DataFrame:
    """The rows the signed-in readers may see: only their own. There is no read without a reader."""
    if isinstance(readers, DataFrame):
        return rows.join(readers.select("user_id").where("user_id is not null"), "user_id", "left_semi").select(*rows.columns)
    if not readers:
        raise PermissionError("a user id is required")
    return rows.where(F.col("user_id") == F.lit(readers))


def may_access(reader: Column, owner: Column) -> Column:
    """Whether a signed-in reader may read or write an owner's rows."""
    return F.coalesce(reader.isNotNull() & (reader == owner), F.lit(False))


def duplicate_votes(votes: DataFrame) -> DataFrame:
    """Keys with more than one vote, which the reader treats as an error."""
    return votes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_votes")).where("n_votes > 1")
