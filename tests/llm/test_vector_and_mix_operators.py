"""Whitening, hard negatives and source mixing against plain versions, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from feedtide.llm import hard_negatives, mixing, queries, whitening

DATA = Path("/root/testdata/sf0.001")
VECTORS = "vec_id long, embedding array<double>, label int, rank string, score string, n string, target string"


def _table(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)


def _spoilt(width):
    """Rows that take no part."""
    nan, inf = float("nan"), float("inf")
    return [(901, None, 1), (902, [None] + [1.0] * (width - 1), 1), (903, [nan] * width, 1), (904, [inf] * width, 1),
            (905, [], 1), (906, [1.0] * (width + 1), 1), (907, [1e300] * width, 1)]


@pytest.fixture(scope="module")
def tables():
    if not DATA.exists():
        pytest.skip("test tables are not here")
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_source_mixing"])
def test_query_equals_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, str(DATA))
    want = tables.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(want.columns) == sorted(got.columns)
    mine = sorted(map(tuple, got.select(*want.columns).collect()))
    assert mine == sorted(map(tuple, want.itertuples(index=False, name=None)))


# ------------------------------------------------------------------ whitening


def _dense(vectors):
    """(distinct x vectors, eigenvalues, eigenvectors) the plain way."""
    x = np.unique(np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000, axis=0)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("width, n", [(1, 40), (3, 200), (20, 300), (24, 9)])
def test_whitening_equals_eigenvectors(spark, width, n):
    rng = np.random.default_rng(width)
    base = rng.normal(size=(n, width)) * np.linspace(1, 9, width) + rng.normal(size=width) * 30
    base[: n // 3] = base[0]  # a third of all rows are one vector
    rows = [(i // 2, [float(v) for v in x], 1) for i, x in enumerate(base)]
    got = whitening.whiten(_table(spark, rows + _spoilt(width)).repartition(4)).collect()
    x, values, axes = _dense(base)
    rank = min(width, len(x) - 1, 16)
    assert len(got) == n * rank
    every = np.floor(64 * base).astype(np.int64) + 1_000_000
    want = (every - x.mean(axis=0)) @ axes[:, :rank] / np.sqrt(values[:rank])
    for k in range(1, rank + 1):
        own = sorted((r.vec_id, r.whitened) for r in got if r.component == k)
        either = [sorted(zip((i // 2 for i in range(n)), s * want[:, k - 1])) for s in (1, -1)]
        assert any(np.allclose(np.array(own), np.array(e), atol=1e-6) for e in either)
    sums = x.sum(axis=0)
    far = Counter((i // 2, int(((len(x) * v - sums) ** 2).sum())) for i, v in enumerate(every))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == far
    assert {r.n for r in got} == {len(x)} and max(r.identity_error for r in got) < 1e-8
    shares = [next(r.explained for r in got if r.component == k + 1) for k in range(rank)]
    assert np.allclose(shares, values[:rank] / values.sum(), rtol=1e-9)


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for width, rank in [(1, 1), (5, 5), (7, 3), (6, 0), (30, 30)]:
        half = rng.normal(size=(width, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
        a = half @ half.T
        pivots, lower = whitening.pivoted_cholesky(a)
        assert lower.shape[1] <= max(rank, 0) and np.allclose(np.triu(lower, 1), 0)
        assert np.allclose(lower @ lower.T, a[np.ix_(pivots, pivots)], atol=1e-9 * max(np.abs(a).max(initial=0), 1))
        w = whitening.one_sided_jacobi(lower)
        norms = np.linalg.norm(w, axis=0)
        assert np.allclose((w.T @ w) / np.outer(norms, norms), np.eye(w.shape[1]), atol=1e-12)
        assert np.allclose(norms**2, np.linalg.eigvalsh(a)[::-1][: w.shape[1]], rtol=1e-6, atol=1e-12 * np.abs(a).max(initial=0))


def test_whitening_edges(spark):
    one = _table(spark, [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), *_spoilt(2)])
    assert whitening.whiten(one).count() == 0  # one distinct vector has no variance
    assert whitening.whiten(_table(spark, []).limit(0)).count() == 0
    assert whitening.whiten(_table(spark, _spoilt(2)[:5])).count() == 0
    reasons = {r.vec_id: r.reason for r in whitening.left_out(one.where("vec_id <> 907")).collect()}
    assert set(reasons) == {901, 902, 903, 904, 905, 906} and reasons[906] == "another length"
    wide = _table(spark, [(1, [2.0**50, 0.0], 1), (2, [-(2.0**50), 1.0], 1), (None, [0.0, 5.0], 1)])
    found = {r.vec_id: (r.deviation, int(r.deviation_text)) for r in whitening.whiten(wide).where("component = 1").collect()}
    assert set(found) == {1, 2, None} and found[1][0] is None and found[1][1] > 2**63


# ------------------------------------------------------------------ hard negatives


def _mined(rows, every=50, positives=5, negatives=3, band=(50, 95)):
    rows = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows]
    out = []
    for anchor, a, label in rows:
        if anchor % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v)), i, other) for i, v, other in rows if i != anchor)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and band[0] * -p <= 100 * -s[0] <= band[1] * -p]
            out += [(anchor, positive, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("seed, block_rows", [(0, 8), (1, 50), (2, 1024)])
def test_hard_negatives_equal_brute_force(spark, seed, block_rows):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(240):
        near = centres[rng.integers(6)] + rng.normal(size=8) * 0.3
        rows.append((int(rng.integers(-100, 400)), [float(v) for v in near], int(rng.integers(3))))
    rows += [(50 * i, rows[0][1], 1) for i in range(20)] + [(7, rows[0][1], 2)] * 30  # equal vectors, repeated rows
    got = hard_negatives.mine(_table(spark, rows + _spoilt(8)).repartition(5), block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == _mined(rows)


def test_zone_maps_leave_blocks_unread(spark):
    """Far clusters: an anchor's windows meet few blocks."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(16):
        centre = np.zeros(16)
        centre[c] = 4.0
        rows += [(c * 100 + i, [float(v) for v in centre + rng.normal(size=16) * 0.02], i % 2) for i in range(64)]
    table = hard_negatives.blocks(
        _table(spark, rows).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(256 * x).cast("int")).alias("q")),
        16, 32,
    )
    anchors = hard_negatives._anchors(table, 16, 50, 5)
    n, n_blocks = anchors.count(), table.count()
    first = anchors.withColumns({"lows": F.array("low"), "highs": F.array(F.lit(2**62))})
    asked = hard_negatives._asked(hard_negatives._groups(first, n), table, n_blocks, 16, 1, True)
    read = asked.select(F.sum(F.size("anchors")).alias("n")).first().n
    assert n_blocks >= 32 and n == 32 and read < n * n_blocks / 4


def test_bounds_hold():
    rng = np.random.default_rng(8)
    for scale in (100, 2**26):
        block = rng.integers(-scale, scale, size=(40, 12))
        a = rng.integers(-scale, scale, size=(9, 12))
        least, most = hard_negatives.bounds(a, block.min(axis=0)[None], block.max(axis=0)[None])
        exact = a.astype(object) @ block.astype(object).T
        assert (hard_negatives.inner(a, block) == exact).all()
        assert (least <= exact).all() and (most >= exact).all()


@pytest.mark.parametrize("width, bits", [(2, 2), (3, 2), (2, 4)])
def test_hilbert_neighbours(width, bits):
    """Along the curve each step changes one dimension by one, and every cell is met once."""
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * width, indexing="ij"), axis=-1).reshape(-1, width)
    keys = [bytes(k) for k in hilbert_keys_of(cells, bits)]
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == len(cells)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def hilbert_keys_of(cells, bits):
    return hard_negatives.hilbert_keys(cells, bits)


def test_hard_negative_edges(spark):
    assert hard_negatives.mine(_table(spark, []).limit(0)).count() == 0
    assert hard_negatives.mine(_table(spark, _spoilt(2)[:5])).count() == 0
    unnamed = [(None, [1.0, 1.0], 1), (50, [1.0, 1.0], None), (100, [1.0, 0.0], 1)]
    assert hard_negatives.mine(_table(spark, unnamed)).count() == 0  # no positive is left
    reasons = {(r.vec_id, r.reason) for r in hard_negatives.left_out(_table(spark, unnamed)).collect()}
    assert reasons == {(None, "no vec_id"), (50, "no label")}
    assert hard_negatives.mine(_table(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no anchor


# ------------------------------------------------------------------ mixing

DOCS = "doc_id long, text string, source string, lang string, size string, target string, row string, key string, h string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", "t", "r", "k", "h") for r in rows], DOCS)


def _mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    """Water-filling by rounds in fractions, and the seeded order, in plain Python."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = Fraction(share) * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if most * sizes[s] < level * weight[s]}
        target |= {s: Fraction(most * sizes[s]) for s in above} | ({} if above else {s: level * weight[s] for s in open_})
        left, open_ = left - sum(most * sizes[s] for s in above), (open_ - above if above else set())
    place = {}
    for i, (doc_id, text, source) in enumerate(rows):
        digest = hashlib.md5(f"mix:{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        place[i] = (int(digest[:15], 16), int(digest[15:30], 16))
    out = []
    for source in order:
        whole = math.floor(target[source] / sizes[source]) if sizes[source] else 0
        rest = math.floor(target[source] - whole * sizes[source] + Fraction(1, 2))
        for i in sorted((i for i in place if rows[i][2] == source), key=place.get):
            size = len(WORDS.findall(rows[i][1] or ""))
            extra = min(rest, size)
            rest -= extra
            out.append((rows[i][0], size, sizes[source], round(float(target[source]), 6), whole * size + extra))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(150):
        source = [None, "", "a", "b", "z", "ä", "\U0001f600", "only"][int(rng.integers(7)) if i else 7]
        text = "".join(rng.choice(["w", " ", "\n", "é", "\x0b", "\x1c"]) for _ in range(int(rng.integers(0, 60))))
        rows.append((int(rng.integers(40)) if i % 9 else None, None if i % 23 == 5 else text, source))
    rows += [(7, "same words here again", "a")] * 60 + [(8, "", "empty"), (9, None, "empty")]
    got = mixing.mix(_docs(spark, rows).repartition(6))
    mine = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)
            for r in got.select("row.doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(mine, key=repr) == _mix(rows)
    assert all(taken <= 2 * size for _, size, _, _, taken in mine)


def test_mix_of_copies_only(spark):
    """All rows are one row: copies are taken one after another, over all files."""
    rows = [(1, "one two three four five", "a")] * 90 + [(2, "x " * 2000, "b")]
    got = mixing.mix(_docs(spark, rows).repartition(7), most=1.75, share=1.2).collect()
    taken = Counter(r.taken for r in got if r.size == 5)
    assert sum(k * n for k, n in taken.items()) == math.floor(next(r.target for r in got if r.size == 5) + 0.5)
    assert len([k for k in taken if k not in (5, 10)]) <= 1


def test_many_sources_join_by_key(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), f"s{i % 12}") for i in range(120)]
    want = sorted(map(repr, mixing.mix(_docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    assert sorted(map(repr, mixing.mix(_docs(spark, rows)).collect())) == want


def test_mixed_rows(spark):
    rows = [(i, f"a{i}  b\nc d" if i % 5 else None, ["x", "y", None][i % 3]) for i in range(60)] + [(99, "long " * 20000, "x")]
    docs = _docs(spark, rows)
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    plan = mixing.mix(docs).select("row.doc_id", "taken").collect()
    words = Counter()
    for r in made.collect():
        words[r.doc_id] += len(WORDS.findall(r.text))
        assert (dict((i, t) for i, t, _ in rows)[r.doc_id]).startswith(r.text)
        assert (r.size, r.key, r.h) == ("s", "k", "h")
    assert words == Counter({r.doc_id: r.taken for r in plan if r.taken})


def test_mix_edges(spark):
    assert mixing.mix(_docs(spark, []).limit(0)).count() == 0
    bare = mixing.mix(_docs(spark, [(1, None, None), (2, "", "a"), (2, "", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in bare] == [(0, 0.0, 0)] * 3
