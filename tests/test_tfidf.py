"""Golden corpus, pooling, fan-out and table shapes."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from feedtide.operators import matrix, quality, tfidf
from feedtide.plans import trends
from feedtide.sinks.tables import TERM_COLUMNS_WITHOUT_FEED, overwrite_terms, read_terms
from feedtide.sources.items import distinct_items, keyed_documents, scored_terms

GOLDEN_ITEMS = [("1.txt", "abc def ghi", "url1.rss"), ("2.txt", "abc def", "url1.rss"), ("3.txt", "abc", "url2.rss")]
GOLDEN = {
    **{("abc", feed, uri): 0.0 for feed in ("url1.rss", "url2.rss") for uri in ("1.txt", "2.txt", "3.txt")},
    ("def", "url1.rss", "1.txt"): 0.13515503603605478,
    ("def", "url1.rss", "2.txt"): 0.2027325540540822,
    ("ghi", "url1.rss", "1.txt"): 0.3662040962227032,
}


def items(spark, rows=GOLDEN_ITEMS):
    return spark.createDataFrame(rows, "link string, title string, feedUrl string")


def as_dict(rows, *keys):
    return {tuple(r[k] for k in keys): r["tfidf"] for r in rows.collect()}


@pytest.mark.parametrize("min_hot_rows", [None, 1])
def test_golden_word_scope(spark, min_hot_rows):
    inputs = trends.term_inputs(items(spark))
    scored = tfidf.scores(inputs.counts, inputs.frequencies, inputs.attributes, min_hot_rows)
    rows = tfidf.fan_out_by_word(scored, inputs.frequencies, min_hot_rows)
    got = as_dict(rows, "word", "feedUrl", "uri")
    assert rows.count() == len(GOLDEN)
    assert got == pytest.approx(GOLDEN, abs=1e-9)
    own = as_dict(tfidf.fan_out_by_document(scored, inputs.attributes, min_hot_rows), "word", "feedUrl", "uri")
    foreign = {("abc", "url1.rss", "3.txt"), ("abc", "url2.rss", "1.txt"), ("abc", "url2.rss", "2.txt")}
    assert own == pytest.approx({k: v for k, v in GOLDEN.items() if k not in foreign}, abs=1e-9)


@pytest.mark.parametrize("min_hot_rows", [None, 1])
@pytest.mark.parametrize("feeds_a_list", [3, 100])
def test_feeds_travel_as_lists(spark, monkeypatch, min_hot_rows, feeds_a_list):
    monkeypatch.setattr(tfidf, "FEEDS_A_LIST", feeds_a_list)
    rows = [(f"l{i}", f"a {'b' if i % 2 else 'c'} d{i % 5 * 'x'}", None if i == 7 else f"f{i % 11}") for i in range(60)]
    inputs = trends.term_inputs(items(spark, rows))
    scored = trends.staged(trends.score_terms(inputs), "scores")
    fanned = tfidf.fan_out_by_word(scored, inputs.frequencies, min_hot_rows)
    assert "Generate inline(feeds" in fanned._jdf.queryExecution().optimizedPlan().toString()  # the join makes no row a feed
    own = [(r.word, r.uri, r.tfidf, r.firstFeed) for r in scored.collect()]
    feeds = {(word, feed) for word, _, _, feed in own}
    want = [(word, feed, uri, value) for word, uri, value, _ in own for of, feed in feeds if of == word]
    assert sorted(map(repr, map(tuple, fanned.collect()))) == sorted(map(repr, want))
    told = trends.terms_by_feed(inputs, score=F.round("tfidf", 2))
    assert sorted(map(repr, map(tuple, told.select("word", "feedUrl", "uri", "tfidf").collect()))) == sorted(
        map(repr, map(tuple, fanned.withColumn("tfidf", F.round("tfidf", 2)).collect()))
    )


def test_pooling_of_one_link(spark):
    rows = [
        ("a", "x x y", "f2"), ("a", "x x y", "f2"), ("a", "x x y", "f1"), ("a", "z", "f1"), ("b", "y", "f3"),
        ("c", None, "f3"), ("d", "123 é", "f4"), (None, "lost", "f4"),
    ]
    inputs = trends.term_inputs(items(spark, rows))
    got = as_dict(trends.score_terms(inputs), "word", "uri")
    assert got == pytest.approx({
        ("x", "a"): 4 / 7 * math.log(4), ("y", "a"): 2 / 7 * math.log(2), ("z", "a"): 1 / 7 * math.log(4),
        ("y", "b"): math.log(2),
    })
    assert {(r.word, r.feedUrl) for r in tfidf.word_feeds(inputs.counts, inputs.attributes).collect()} == {
        ("x", "f1"), ("y", "f1"), ("z", "f1"), ("y", "f3"),
    }
    assert [(r.uri, r.reason) for r in quality.untitled_documents(inputs.docs).collect()] == [("c", "null_title")]
    by_doc = trends.terms_by_feed(inputs, "document")
    assert {(r.uri, r.feedUrl) for r in by_doc.collect()} == {("a", "f1"), ("a", "f2"), ("b", "f3")}


def test_counts_and_scores_are_not_shuffled_by_document(spark):
    """Texts are, by document alone; scores then know the length and feeds of their document."""
    rows = items(spark, [(f"l{i}", f"a b c{i}", f"f{i % 3}") for i in range(40)] + [("l1", "d", None), ("l1", "d", "f9")])
    inputs = trends.term_inputs(rows)
    scored = trends.score_terms(inputs)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(n#" not in plan and "min(feedUrl#" not in plan  # neither is told again, nor joined
    assert {r.n_feeds for r in scored.where("uri = 'l1'").collect()} == {3}
    own = trends.terms_by_feed(inputs, "document")
    assert {r.feedUrl for r in own.where("uri = 'l1'").collect()} == {"f1", "f9", None}
    assert own.where("uri <> 'l1'").count() == 3 * 39


def test_documents_of_many_texts_are_counted_alike(spark):
    rows = [("a", f"x y{i % 4} x", f"f{i % 2}") for i in range(30)] + [("a", None, None), ("b", "x", "f"), ("c", "", "f")]
    docs = keyed_documents(items(spark, rows))
    few, many = (sorted(map(tuple, tfidf.pooled_counts(docs, hot).collect())) for hot in (10_000, 5))
    assert few == many and ("a", "x", 8, 12, "f0", 3) in few and ("b", "x", 1, 1, "f", 1) in few and len(few) == 3


def test_words(spark):
    rows = [("a", "Don't café \u212a日本 ''' A1b", "f")]  # the third word starts with the Kelvin sign
    docs = keyed_documents(items(spark, rows))
    assert [r.word for r in tfidf.tokens(docs).collect()] == ["don't", "caf", "'''", "a", "b"]


def test_limit_is_repeatable(spark):
    rows = [(str(i), "t", "f") for i in range(9)] + [("0", "t", "f")]
    got = [r.link for r in distinct_items(items(spark, rows), 4).collect()]
    assert got == ["0", "1", "2", "3"]
    limited = trends.term_inputs(distinct_items(items(spark, rows), 4))
    assert tfidf.doc_count(limited.attributes).first()[0] == 4


def test_job_writes_and_replaces(spark, tmp_path):
    path = str(tmp_path / "terms")
    trends.run(items(spark), path)
    trends.run(items(spark), path)
    table = read_terms(spark, path)
    assert table.columns == ["word", "uri", "tfidf", "feedUrl"] and table.count() == 9
    assert scored_terms(table).count() == 9
    overwrite_terms(table, str(tmp_path / "three"), TERM_COLUMNS_WITHOUT_FEED)
    assert read_terms(spark, str(tmp_path / "three")).columns == ["word", "uri", "tfidf"]
    overwrite_terms(table.where("word = 'abc'"), path)  # reads the table it replaces
    assert read_terms(spark, path).count() == 6
    with pytest.raises(Exception):
        overwrite_terms(table.select("word", "uri", "feedUrl", F.raise_error(F.lit("x")).cast("double").alias("tfidf")), path)
    assert read_terms(spark, path).count() == 6


def test_views_of_the_term_table(spark):
    rows = [
        ("aaa.com", "apple", 0.0, "ccc"), ("ddd.com", "banana", 1.0, "ddd.rss"), ("ddd.com", "forest", 5.0, "ccc.rss"),
        ("ddd.com", "forest", 5.0, "ddd.rss"), ("bbb.com", "cola", 3.0, None),
    ]
    table = spark.createDataFrame(rows, "uri string, word string, tfidf double, feedUrl string")
    assert [r.uri for r in tfidf.document_list(table).collect()] == ["aaa.com", "bbb.com", "ddd.com"]
    assert {r.word for r in tfidf.vocabulary(table).collect()} == {"apple", "banana", "cola", "forest"}
    terms = {r.uri: [tuple(t) for t in r.terms] for r in tfidf.uri_terms(table).collect()}
    assert terms["ddd.com"] == [("banana", 1.0), ("forest", 5.0), ("forest", 5.0)]
    feeds = {r.uri: r.feeds for r in tfidf.uri_feeds(table).collect()}
    assert feeds["ddd.com"] == ["ccc.rss", "ddd.rss"]
    assert scored_terms(table).where(F.col("uri") == "bbb.com").count() == 0


def test_path_keys(spark):
    frame = spark.createDataFrame([("a/b",), ("a_b",), ("c",)], "uri string")
    assert [tuple(r) for r in quality.key_collisions(frame, "uri").collect()] == [("a_b", 2)]


def test_cells_need_no_fan_out(spark, monkeypatch):
    rows = [*GOLDEN_ITEMS, ("4.txt", "abc jkl", None), ("1.txt", "abc def ghi", "url2.rss"), ("1.txt", "more", "url2.rss")]
    inputs = trends.term_inputs(items(spark, rows))
    own = as_dict(matrix.score_cells(trends.score_terms(inputs)), "uri", "word")
    for scope in ("word", "document"):
        assert own == as_dict(matrix.cells(trends.terms_by_feed(inputs, scope)), "uri", "word")

    def refused(*args):
        raise AssertionError("fanned out")

    monkeypatch.setattr(tfidf, "fan_out_by_word", refused)
    assert __spark_entry__.queries()["matrix_cells"](spark, "/root/testdata/sf0.001").count() == 46_670
