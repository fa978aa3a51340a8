"""Sharding, line dedup, similarity join, vector search, byte dedup and the pipeline against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from feedtide.llm import jaccard_join, line_dedup, one_bit_search, queries, repeated_bytes, secret_scan, sharding, toxicity
from feedtide.llm.components import connected

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, shard string, n_lines string"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _frame(spark, texts):
    rows = [(d, t, "x", "y") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, str(DATA))
    want = connection.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    theirs = want[columns].astype(object).where(want[columns].notna(), None)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, theirs.itertuples(index=False, name=None)))


def _plain_shards(rows, limit):
    def split(own, depth, prefix):
        if sum(n for _, _, n in own) <= limit or depth == sharding.BITS:
            return {(i, prefix) for i, _, _ in own}
        bit = lambda h: h >> (sharding.BITS - depth - 1) & 1
        return set().union(*(split([r for r in own if bit(r[1]) == b], depth + 1, f"{prefix}{b}") for b in (0, 1)))

    return split(rows, 0, "")


@pytest.mark.parametrize("limit", [40, 300, 10_000])
def test_shards(spark, none, limit):
    texts = [(i, "ab" * (i % 17)) for i in range(120)] + [(None, None), (5, ""), (7, "x" * 500), (7, "x" * 500)]
    got = sharding.shard(_frame(spark, texts), limit).collect()
    rows = []
    for i, (d, t) in enumerate(texts):
        digest = hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()
        rows.append((i, int(digest[:15], 16), len(t or "")))
    want = Counter((texts[i][0], texts[i][1], prefix) for i, prefix in _plain_shards(rows, limit))
    assert Counter((r.doc_id, r.text, r.shard) for r in got) == want
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert all(r.over_limit == (sizes[r.shard] > limit) and len(r.shard) == r.depth for r in got)
    assert sharding.shard(none, limit).count() == 0


def test_line_dedup_finds_shifted_passages(spark, none):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(6))
    passage = [line() for _ in range(30)]
    texts = [(i, "\n".join([line() for _ in range(rng.randint(1, 9))] + passage + [line()])) for i in range(20)]
    texts += [(100, None), (101, ""), (None, texts[0][1]), (3, texts[3][1]), (102, "one line"), (103, "one line")]
    docs = _frame(spark, texts)
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None and 1 <= r.doc_id < 20:
            assert r.n_removed == 30
        if r.doc_id == 0 or (r.doc_id or 0) >= 100:
            assert r.n_removed == 0
    assert [r.text for r in got if r.doc_id in (100, 101)] in ([None, ""], ["", None])
    assert len({r.text for r in got if r.doc_id == 3}) == 1
    assert line_dedup.dedup(none).count() == 0 and line_dedup.drop_repeated(docs).columns == docs.columns


def test_repeated_passages_go_whole(spark):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(9))
    planted = [[line() for _ in range(n)] for n in (2, 2, 3, 3, 4, 7, 20)]
    planted += [["gap " + line(), "", "", "", line()], [line(), "", line()]]
    texts, want = [], {}
    for i in range(40):
        own, passage = [line() for _ in range(4)], planted[i % len(planted)]
        texts.append((i, "\n".join([*own[:2], *passage, *own[2:]])))
        want[i] = "\n".join([*own[:2], *(passage if i < len(planted) else []), *own[2:]])
    texts += [(100 + i, t) for i, (_, t) in enumerate(texts)]  # exact copies
    twins = line()
    texts += [(200, "\n".join([twins] * 5)), (201, "one\n\n\n\ntwo"), (202, "three\n\n\n\nfour")]
    want |= {200: f"{twins}\n{twins}", 201: texts[-2][1], 202: texts[-1][1]}
    got = line_dedup.drop_repeated(_frame(spark, texts)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)


def _plain_gone(texts):
    """Line numbers to remove of each text, by comparing all pieces of all texts with each other."""
    first, gone = {}, {}
    for doc, text in sorted(texts):
        lines = text.split("\n")
        stops = [-1, *[i for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line)], len(lines)]
        spans = set()
        for a, b in zip(stops, stops[1:]):
            spans |= {(a, a + 1)} | ({(b - 1, b)} if b - a >= 2 else set()) | ({(a + 1, b)} if b - a >= 3 else set())
        gone[doc] = set()
        for low, high in sorted(spans):
            if low < 0 or high >= len(lines):
                continue
            seen, at = first.setdefault("\n".join(lines[low : high + 1]), (doc, low))
            if (seen, at) != (doc, low) and not (seen == doc and low <= at + high - low):
                gone[doc] |= set(range(low, high + 1))
    return gone


def test_line_dedup_equals_brute_force(spark):
    for seed in range(10):
        rng = random.Random(seed)
        pool = ["", " ", *[f"line {i}" for i in range(rng.choice([3, 8, 30]))]]
        passage = [rng.choice(pool) for _ in range(12)]
        texts = []
        for doc in range(25):
            lines = [rng.choice(pool) for _ in range(rng.randrange(14))]
            if rng.random() < 0.6:
                low = rng.randrange(10)
                lines[len(lines) // 2 : 0] = passage[low : low + rng.randrange(2, 13)]
            texts.append((doc, "\n".join(lines)))
        gone = _plain_gone(texts)
        want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts}
        got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(_frame(spark, texts)).collect()}
        assert got == {d: (want[d], len(gone[d])) for d in want}


def test_line_dedup_of_very_long_texts(spark):
    long = "\n".join(f"line {i} of a text of more than a megabyte, and its words" for i in range(20_000))
    got = {r.doc_id: r for r in line_dedup.dedup(_frame(spark, [(0, long), (1, f"own line\n{long}"), (2, "x" * 1_000_000)])).collect()}
    assert (got[0].text, got[1].text, got[1].n_removed, got[2].n_removed) == (long, "own line", 20_000, 0)


def test_chunks_are_found_wherever_they_stand(spark):
    """The first cut alone: a long passage loses what lies between its first and last end, whatever was put before it."""
    passage = [f"line {i} of a passage" for i in range(60)]
    docs = _frame(spark, [(i, "\n".join([f"own {i} {k}" for k in range(i % 7)] + passage)) for i in range(9)])
    spans = line_dedup.repeated(docs, line_dedup.chunks).collect()
    lengths = {d: sum(r.last - r.first + 1 for r in spans if r.doc_id == d) for d in range(9)}
    assert lengths[0] == 0 and all(n > 20 for d, n in lengths.items() if d)


def test_wordless_remainders_go(spark):
    passage = "first line of it\nsecond line of it\nthird line of it"
    ends = ["", "\n\n", "\n \n\t", "\nSHOUT", "\n====", "\n:", "\n2", "\nword"]
    docs = _frame(spark, [(0, passage), *[(i + 1, passage + end) for i, end in enumerate(ends)], (50, "\n"), (51, None)])
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated(docs).collect()}
    assert got == {0: passage, 4: "SHOUT", 5: "====", 6: ":", 7: "2", 8: "word", 50: "\n", 51: None}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {n: n for pair in links for n in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected(spark.createDataFrame(links, "a long, b long"))
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {(r.node, r.component) for r in got.collect()} == {(n, root(n)) for n in linked}


def _plain_components(texts, width, percent):
    sets, words = [], r"[^\x20\x09-\x0D]+"
    for _, t in texts:
        own = re.findall(words, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(own[i : i + width]) for i in range(max(len(own) - width + 1, 1))} if own else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[root(i)].append(texts[i][0])
    least = {r: min((d for d in own if d is not None), default=None) for r, own in groups.items()}
    return Counter((texts[i][0], len(sets[i]), least[root(i)] if sets[i] else texts[i][0]) for i in range(len(texts)))


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, none, width, percent):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcde", k=3))
    texts, passage = [], [word() for _ in range(30)]
    for i in range(60):
        base = [word() for _ in range(rng.randint(5, 90))]
        if i % 3 == 0:
            base[2:2] = passage
        texts.append((10 * i, " ".join(base)))
        for copy in range(rng.choice([0, 0, 1, 2, 40 if i == 7 else 3])):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = word()
            texts.append((10 * i + copy + 1, " ".join(edited).upper() if copy % 2 else "\t".join(edited)))
    texts += [(5000, None), (5001, ""), (5002, "É a"), (5003, "é a"), (5004, "a b"), (None, "A B"), (None, " \n"), (5004, "a b")]
    got = jaccard_join.components(_frame(spark, texts), width, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _plain_components(texts, width, percent)
    assert jaccard_join.components(none).count() == 0


def test_sets_come_from_one_text_of_a_class(spark):
    """Texts of one set may differ: whichever is chosen, the set is there once, and sets not wanted are left out."""
    texts = [(i, t) for i, t in enumerate(["A b c d e", "a B\tc d e", "a b c d e", "v w x y z", "", None])]
    docs = _frame(spark, texts).withColumn("text_hash_", F.xxhash64("text"))
    found = jaccard_join.classes(docs, 4, ("doc_id", "text_hash_")).cache()
    orders = spark.sparkContext.broadcast(jaccard_join.orders(found, 6))
    for wanted, n in ((found.where("doc_id < 3"), 1), (found.where("n > 0"), 2), (found.where("n < 0"), 0)):
        got = jaccard_join._sets(docs, 4, 85, orders, wanted, found).collect()
        assert sorted(r.sig for r in got) == sorted({r.sig for r in wanted.collect()}) and len(got) == n
        assert all(r.n == len(r.tokens) == 2 for r in got)


def test_near_copies_that_do_not_link_are_hardly_paired(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, texts = [word() for _ in range(200)], []
    for i in range(150):  # 0.78 alike, but for a few that link
        edited = list(base)
        for at in rng.sample(range(200), 1 if i < 4 else 3):
            edited[at] = word()
        texts.append((i, " ".join(edited)))
    counts, staged = {}, jaccard_join.staged

    def counted(df, label):
        made = staged(df, label)
        counts[label] = made.count()
        return made

    monkeypatch.setattr(jaccard_join, "staged", counted)
    got = jaccard_join.components(_frame(spark, texts), 4, 85)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _plain_components(texts, 4, 85)
    few = counts["candidate-pairs"]
    monkeypatch.setattr(jaccard_join, "_near_sketches", lambda *a: jaccard_join.F.lit(True))
    jaccard_join.components(_frame(spark, texts), 4, 85)
    assert 4 * few < counts["candidate-pairs"], few


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = _frame(spark, [(3, text), (1, text + " x"), (1, text + " x"), (2, "other words here"), (9, None), (9, None), (8, "")])
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, text + " x"), (2, "other words here"), (8, ""), (9, ""), (9, "")]


def test_one_of_each_group_stays_whatever_the_source(spark):
    text = "the same eight words stand in every source"
    rows = [(d, text, s, "y") for d in (None, 4) for s in ("web", "books", "news", None)]
    rows += [(None, text + " alone and again with other words", s, n) for s in ("web", "books") for n in ("y", "z")]
    rows += [(None, None, "a", "y"), (None, None, "b", "y"), (9, "", "a", "y"), (9, "", "b", "y")]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    texts = Counter(r.text for r in kept)
    assert texts == {text: 1, text + " alone and again with other words": 1, None: 2, "": 2}
    assert all(tuple(r) in rows for r in kept)


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    vectors = [(i, (centres[i % 12] + 0.6 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(1200)]
    vectors += [(2000, None), (2001, [0.0] * 32), (2050, [float("nan")] + [1.0] * 31), (2100, [None] + [1.0] * 31), (None, [1.0] * 32)]
    vectors += [(3000 + i, vectors[50][1]) for i in range(8)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = one_bit_search.nearest(frame, frame.where("vec_id % 50 = 0"), k=5).collect()
    good = [(i, np.array(v, np.float64)) for i, v in vectors[:1200] + vectors[1205:]]
    ids = np.array([i for i, _ in good])
    matrix = np.array([v for _, v in good])
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for query in ids[ids % 50 == 0]:
        own = matrix[ids == query][0]
        scores = matrix @ own / np.sqrt((matrix**2).sum(1) * (own**2).sum())
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if ids[i] != query][:5]
        answers = sorted(found[query])
        assert [a[0] for a in answers] == [1, 2, 3, 4, 5]
        hits += len({ids[i] for i in order} & {a[1] for a in answers})
        assert all(abs(s - scores[ids == v][0]) < 1e-12 for _, v, s in answers)
    assert hits >= 0.98 * 5 * len(found) and set(found) == set(ids[ids % 50 == 0].tolist())
    assert one_bit_search.nearest(frame.limit(0), frame, k=5).count() == 0
    assert one_bit_search.nearest(frame.where("vec_id < 3"), frame.where("vec_id = 0")).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([1, 512]))
def test_induced_suffix_array(symbols, small):
    text = np.array([*symbols, 0])
    array = repeated_bytes.suffix_array(text, small)
    assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    shared = repeated_bytes.permuted_prefixes(text, array, 7)
    for a, b in zip(array, array[1:]):
        common = 0
        while text[a + common] == text[b + common]:
            common += 1
        assert shared[b] == min(common, 7)


def _plain_byte_dedup(texts):
    seen, out = set(), {}
    for key in sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0)):
        data = (key[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return Counter((d, *out[d, t]) for d, t in texts)


def test_search_of_extreme_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [1e200, 1.0]), (2, [3.0, 4.0]), (3, [5e-324, 0.0]), (4, [-1e308, 1e308]), (5, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in one_bit_search.nearest(frame, frame, k=5).collect()}
    want = {0: (1, 1), 1: (1, 1e-200), 2: (3, 4), 3: (1, 0), 4: (-1, 1)}
    assert set(got) == {(a, b) for a in want for b in want if a != b}
    for (a, b), score in got.items():
        (x, y), (u, v) = want[a], want[b]
        assert score == pytest.approx((x * u + y * v) / (np.hypot(x, y) * np.hypot(u, v)), abs=1e-12)


@pytest.mark.parametrize("most", [2048, 3])
def test_byte_dedup(spark, none, most, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "MOST_IN_SHARD", most)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdé ", k=n))
    passage, long_one = letters(150), letters(4000)
    texts = [(i, letters(rng.randint(0, 300)) + passage[rng.randint(0, 30) :] + letters(rng.randint(0, 80))) for i in range(40)]
    texts += [(50 + i, long_one[: 500 * i] + "#" + long_one[500 * i + 3 :]) for i in range(6)]
    texts += [(70, "a" * 1000), (71, "a" * 99), (72, "ab" * 300), (73, None), (74, ""), (75, "a" * 100), (None, passage)]
    texts += [(50, texts[40][1])]
    got = repeated_bytes.without_repeats(_frame(spark, texts)).collect()
    assert Counter(tuple(r) for r in got) == _plain_byte_dedup(texts)
    assert repeated_bytes.without_repeats(none).count() == 0


def test_stages_keep_clashing_columns(spark):
    """Extra columns named like the stages' own come back as they were."""
    names = ["score", "text_", "was_null_", "copies_", "same_", "row_", "cuts_", "cut_id_", "n_lines", "n_removed", "gone_", "sig"]
    passage = "\n".join(f"line {k} of a passage that comes back" for k in range(6))
    texts = [passage, f"own words here\n{passage}", "password = hunter2hunter2", None, "", "plain text of its own", passage]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    stages = (
        lambda d: toxicity.drop_toxic(d, labels), line_dedup.drop_repeated, jaccard_join.drop_near_copies,
        lambda d: secret_scan.redact(d, None),
    )
    for stage in stages:
        made = stage(docs)
        assert made.columns == docs.columns
        for row in made.collect():
            assert [row[n] for n in names] == [f"{n}{row.doc_id}" for n in names]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(DATA))
        assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(made.collect(), made.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert pieces.select("doc_id").distinct().count() == docs.count()
    # Nothing in the result is a near copy of something else in it.
    again = jaccard_join.components(docs)
    assert again.groupBy("component_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(DATA)).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, pieces.select("doc_id", "piece", "ids_crc32").collect())
    )
