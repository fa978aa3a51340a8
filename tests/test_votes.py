"""Vote state machine, vote table and timelines."""

import datetime as dt
import itertools

import pytest

from feedtide import schemas
from feedtide.operators import timeline, votes

T0 = dt.datetime(2024, 1, 1)


def fold(start, actions):
    """The button, pressed step by step."""
    state = start
    for action in actions:
        sign = 1 if action == "up" else -1
        state = 0 if state == sign else sign
    return state


def histories(max_length):
    for length in range(1, max_length + 1):
        yield from itertools.product(("up", "down"), repeat=length)


def action_rows(keyed):
    rows, event = [], 0
    for uri, actions in keyed:
        for step, action in enumerate(actions):
            rows.append(("u", uri, f"title {uri}", T0, action, T0 + dt.timedelta(seconds=step // 2), event))
            event += 1
    return rows


@pytest.mark.parametrize("min_hot_rows", [None, 2])
def test_every_short_history(spark, min_hot_rows):
    cases = {f"{start}:{'-'.join(h)}": (start, h) for start in (-1, 0, 1) for h in histories(8)}
    actions = spark.createDataFrame(action_rows((k, h) for k, (_, h) in cases.items()), schemas.VOTE_ACTIONS)
    stored = [("u", f"d{k}", k, "old", s, T0) for k, (s, _) in cases.items() if s]
    table = spark.createDataFrame(stored, schemas.VOTES)
    got = {r.uri: (r.old_state, r.state) for r in votes.vote_states(actions, table, min_hot_rows=min_hot_rows).collect()}
    assert got == {k: (s, fold(s, h)) for k, (s, h) in cases.items()}


def test_vote_table(spark):
    stored = [
        ("u", "d1", "kept", "t", 1, T0), ("u", "d2", "deleted", "t", 1, T0),
        ("u", "d3", "updated", "t", -1, T0), ("u", "d4", "bad", "t", 7, T0), ("u", "d5", "updated", "second", 1, T0),
    ]
    table = spark.createDataFrame(stored, schemas.VOTES)
    pressed = [("deleted", ["up"]), ("updated", ["up"]), ("inserted", ["down"]), ("nothing", ["up", "up"])]
    actions = spark.createDataFrame(action_rows(pressed), schemas.VOTE_ACTIONS)
    rows = votes.apply_votes(table, actions).collect()
    got = {r.doc_id: (r.uri, r.title, r.state) for r in rows if r.uri != "inserted"}
    # A second vote on the key and one in an unknown state are no business of the actions.
    assert got == {
        "d1": ("kept", "t", 1), "d3": ("updated", "t", 1), "d4": ("bad", "t", 7), "d5": ("updated", "second", 1),
    }
    assert [(r.title, r.state) for r in rows if r.uri == "inserted"] == [("title inserted", -1)]
    changes = {r.uri: r.change for r in votes.vote_changes(votes.vote_states(actions, table)).collect()}
    assert changes == {"deleted": "delete", "updated": "update", "inserted": "insert"}
    assert [r.uri for r in votes.invalid_votes(table).collect()] == ["bad"]


def test_invalid_actions(spark):
    rows = action_rows([("a", ["up"])]) + [("u", "a", "t", T0, "sideways", T0, 9), ("u", "a", "t", T0, "up", None, 10)]
    actions = spark.createDataFrame(rows, schemas.VOTE_ACTIONS)
    assert sorted(r.reason for r in votes.invalid_actions(actions).collect()) == ["no_order", "unknown_action"]
    assert votes.vote_states(actions).first().state == 1


def test_scope_and_lists(spark):
    rows = [
        ("u", "b", "x", "t", 1, T0 + dt.timedelta(1)), ("u", "a", "y", "t", -1, T0),
        ("v", "c", "x", "t", 1, T0), ("u", "z", "y", "t", 1, T0),
    ]
    table = spark.createDataFrame(rows, schemas.VOTES)
    assert [r.doc_id for r in votes.voted_list(table, "u").collect()] == ["a", "z", "b"]
    both = spark.createDataFrame([("v",), ("u",), ("u",), (None,)], "user_id string")
    assert [r.doc_id for r in votes.voted_list(table, both).collect()] == ["a", "z", "b", "c"]
    assert votes.voted_list(table, both.where("user_id = 'v'")).columns == table.columns
    assert [(r.uri, r.n_votes) for r in votes.duplicate_votes(table).collect()] == [("y", 2)]
    with pytest.raises(PermissionError):
        votes.for_user(table, "")


@pytest.mark.parametrize("min_hot_rows", [None, 1])
def test_timeline(spark, min_hot_rows):
    us = dt.timedelta(microseconds=1)
    items = spark.createDataFrame(
        [
            ("f1", "FeedTypes.ATOM", "one", "http://1", T0), ("f2", "FeedTypes.ATOM", "two", "http://2", T0 + us),
            ("f2", "FeedTypes.ATOM", "late", "http://3", None),
        ],
        schemas.FEED_ITEMS,
    )
    subs = spark.createDataFrame(
        [("u", "1", None, "f1", T0), ("u", "2", None, "f2", T0), ("v", "3", None, "f1", T0), ("w", "4", None, "f9", T0)],
        schemas.FEED_URIS,
    )
    table = spark.createDataFrame(
        [
            ("u", "d1", "http://1", "voted one", 1, T0), ("u", "d2", "http://2", "t", 1, T0),
            ("v", "d3", "http://1", "t", -1, T0 - us), ("u", "d4", "http://1", "t", -1, T0 - 2 * us),
        ],
        schemas.VOTES,
    )
    rows = timeline.user_items(subs, items, min_hot_rows)
    assert [(r.user_id, r.title) for r in timeline.timeline(rows).collect()] == [("u", "two"), ("u", "one"), ("v", "one")]
    assert [r.title for r in timeline.untimed_items(items).collect()] == ["late"]
    assert sorted((r.user_id, r["rank"], r.title) for r in timeline.timeline_page(subs, items, 1, min_hot_rows).collect()) == [
        ("u", 1, "two"), ("v", 1, "one"),
    ]
    got = {(r.user_id, r.uri): (r.state, r.doc_id, r.title) for r in timeline.with_votes(rows, table).collect()}
    assert got == {
        ("u", "http://1"): (1, "d1", "voted one"), ("u", "http://2"): (0, None, "two"), ("v", "http://1"): (0, None, "one"),
    }
    kept = timeline.votes_since_oldest_item(subs, items, table, min_hot_rows)
    assert sorted(r.doc_id for r in kept.collect()) == ["d1", "d2"]
    assert kept.columns == table.columns
