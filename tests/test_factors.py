"""Totals and lookups from the factors of the fan-out equal those of its rows."""

import random

import pytest
from pyspark.sql import functions as F

from feedtide.operators import factors


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [
        (f"w{w}", f"d{d}", 1.0 / (1 + w * d), rng.choice(["f0", "f1", "f2", None]) if w else f"f{d % 5}")
        for d in range(40)
        for w in sorted({0, *(rng.randrange(12) for _ in range(4))})
    ]
    return spark.createDataFrame(rows, "word string, uri string, tfidf double, firstFeed string")


@pytest.fixture(scope="module")
def pairs(scored):
    rows = scored.collect()
    feeds = {(r.word, r.firstFeed) for r in rows if r.firstFeed}
    return sorted((r.word, r.uri, r.tfidf, f) for r in rows for w, f in feeds if w == r.word)


def _totals(pairs, at):
    out = {}
    for row in pairs:
        n, total, low, high, words = out.get(row[at], (0, 0.0, 9.0, -9.0, frozenset()))
        out[row[at]] = (n + 1, total + row[2], min(low, row[2]), max(high, row[2]), words | {row[0]})
    return out


@pytest.mark.parametrize("hot", [None, 5])
def test_totals(scored, pairs, hot):
    made = factors.factorise(scored)
    assert factors.n_rows(made).first()[0] == len(pairs)
    want = _totals(pairs, 3)
    got = {r.feedUrl: r for r in factors.feed_totals(made, hot).collect()}
    assert got.keys() == want.keys()
    for feed, (n, total, low, high, words) in want.items():
        row = got[feed]
        assert (row.n_rows, row.tfidf_min, row.tfidf_max, row.n_words) == (n, low, high, len(words))
        assert row.tfidf_sum == pytest.approx(total)
    want = _totals(pairs, 1)
    got = {r.uri: r for r in factors.document_totals(made, hot).collect()}
    assert got.keys() == want.keys()
    for uri, (n, total, _, _, words) in want.items():
        assert (got[uri].n_rows, got[uri].n_words) == (n, len(words)) and got[uri].tfidf_sum == pytest.approx(total)
    assert sorted(map(tuple, factors.expand(made, hot).collect())) == pairs


def test_lookups_and_storage(spark, scored, pairs, tmp_path):
    factors.write(factors.factorise(scored), str(tmp_path / "f"))
    made = factors.read(spark, str(tmp_path / "f"))
    feed = spark.createDataFrame([("f4",), ("none",)], "feedUrl string")
    few = spark.createDataFrame([("d1",), ("d2",)], "uri string")
    got = factors.cut(made, feeds=feed, uris=few)
    want = [p for p in pairs if p[3] == "f4" and p[1] in ("d1", "d2")]
    assert sorted(map(tuple, factors.expand(got).collect())) == want and want
    assert factors.n_rows(got).first()[0] == len(want)
    word = factors.cut(made, words=spark.createDataFrame([("w0",)], "word string"))
    assert sorted(map(tuple, factors.expand(word).collect())) == [p for p in pairs if p[0] == "w0"]


def test_empty(scored):
    made = factors.factorise(scored.where("false"))
    assert factors.n_rows(made).first()[0] == 0
    assert factors.feed_totals(made).count() == factors.document_totals(made).count() == factors.expand(made).count() == 0
    none = factors.factorise(scored.withColumn("firstFeed", F.lit(None).cast("string")))
    assert factors.n_rows(none).first()[0] == 0 and factors.document_totals(none).count() == 0
