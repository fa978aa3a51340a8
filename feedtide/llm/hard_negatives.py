"""Hard-negative mining over Hilbert-ordered blocks with zone maps (operator 12).

Components become whole numbers, floor(256 x). Rows are ordered along a Hilbert curve through the cells that quartiles
cut each dimension into, and written as Parquet, one row a block of ``BLOCK_ROWS`` vectors, beside the block's zone map:
the smallest and largest value of every dimension and the labels in it. Interval arithmetic on a zone map bounds the
inner product of an anchor with anything in the block, so a block is read for an anchor only if

- it holds the anchor's label and its upper bound reaches the anchor's known fifth-best positive (which the anchor's own
  block tells to begin with), or
- it holds another label and its bounds meet one of the anchor's score windows.

Anchors travel in groups. A group meets the zone maps in chunks, which names the blocks each anchor needs; the anchors
of a group that need a block are sent to it, and only their best rows come back. Bounds are exact (or widened by their
rounding), and scores are exact whole numbers, so nothing is lost where zone maps can't tell blocks apart: then every
block is read, as the stated query set asks.

Defined results: rows with a null vec_id, label or vector, or a vector that is empty or holds null or non-finite
components, take no part; nor do vectors of another length than the commonest (the shorter on a tie), and components
so large that 100 times an inner product need not fit a long (beyond 2^17 for 64 dimensions). ``left_out`` lists them.
Rows that share a vec_id are rows of their own, but never each other's positives or negatives; full copies of an anchor
give their rows once each. Ties go to the smaller vec_id. An anchor without positives, or a window without rows, gives
no row; a negative positive_score leaves an empty window.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedtide.llm.common import lists, small_batches
from feedtide.llm.vectors import common_length, doubles, fault, matrix
from feedtide.session import staged

SCALE = 256
BLOCK_ROWS = 1_024
#: Anchors of a group and zone maps of a chunk; slices of a group that are scored at once.
GROUP, ZONES, SLICE = 1_024, 2_048, 256
#: Parts the curve is cut into at most, each of any number of blocks.
MOST_PARTS = 4_096
#: Quartiles of a normal distribution, in standard deviations (fixed values).
_CUTS = np.array([-0.6745, 0.0, 0.6745])
_EXACT = float(2**53)
_ANY = 2**62

_ANCHORS = "anchors array<long>, ids array<long>, labels array<int>, q binary, lows array<long>, highs array<long>"


def _largest(size: int) -> float:
    """The largest component, so that 100 times any inner product fits a long."""
    return float(isqrt((2**63 - 1) // 100 // max(size, 1)) // SCALE - 1)


def left_out(vectors: DataFrame) -> DataFrame:
    """(vec_id, reason) of the rows that take no part."""
    rows = doubles(vectors, "label")
    size = common_length(rows, _largest(1))
    reason = (
        F.when(F.col("vec_id").isNull(), "no vec_id")
        .when(F.col("label").isNull(), "no label")
        .otherwise(fault(size, _largest(size or 1)))
    )
    return rows.select("vec_id", reason.alias("reason")).where("reason is not null")


def hilbert_keys(levels: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells along a Hilbert curve, as rows of bytes; ``levels`` has a column a dimension, below 2**bits.

    The transposed index is made by undoing the turns of each sub-cube and a Gray code (Skilling, 2004).
    """
    x = levels.astype(np.uint8).copy()
    width = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        q, p = np.uint8(1 << bit), np.uint8((1 << bit) - 1)
        for i in range(width):
            inverted = (x[:, i] & q) != 0
            swapped = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & p).astype(np.uint8)
            x[:, 0] ^= np.where(inverted, p, swapped)
            if i:
                x[:, i] ^= swapped
    for i in range(1, width):
        x[:, i] ^= x[:, i - 1]
    flips = np.zeros(len(x), np.uint8)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where(x[:, -1] & np.uint8(1 << bit), np.uint8((1 << bit) - 1), np.uint8(0))
    x ^= flips[:, None]
    return np.packbits(np.concatenate([x >> bit & 1 for bit in range(bits - 1, -1, -1)], axis=1), axis=1)


def _bytes_array(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(rows), buffers)


def _numbers(value: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.int32).reshape(-1, size)


def _list(batch: pa.RecordBatch, column: str, at: int) -> np.ndarray:
    return batch.column(column)[at].values.to_numpy(zero_copy_only=False)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with anything between the rows of ``low`` and ``high``."""
    up, down = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    slack = 0.0
    reach = np.abs(a).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T
    if reach.max(initial=0.0) >= _EXACT:
        slack = reach * (a.shape[1] * np.finfo(float).eps) + 1
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _spread(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation a dimension. They shape the curve, never a result."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(size), np.zeros(size)
        for batch in batches:
            q = matrix(batch, "q").astype(float)
            n, s, ss = n + len(q), s + q.sum(axis=0), ss + (q * q).sum(axis=0)
        columns = [pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array(s), pa.array(ss)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s", "ss"])

    parts = rows.select("q").mapInArrow(each, "i int, n long, s double, ss double")
    made = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("i")
    n, s, ss = (np.array(c, dtype=float) for c in zip(*[(r.n, r.s, r.ss) for r in made.collect()]))
    return s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 1e-300))


def blocks(rows: DataFrame, size: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The block table of (vec_id, label, q): its vectors in Hilbert order, with the zone map of every block."""
    mean, deviation = _spread(rows, size)
    used = np.argsort(-deviation, kind="stable")[:64]  # two bits each: more dimensions would never decide

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = (matrix(batch, "q")[:, used] - mean[used]) / deviation[used]
                keys = hilbert_keys(np.searchsorted(_CUTS, z.ravel()).reshape(z.shape), 2)
                yield pa.RecordBatch.from_arrays([*batch.columns, _bytes_array(keys)], names=[*batch.schema.names, "key"])

    keyed = rows.mapInArrow(key, "vec_id long, label int, q array<int>, key binary")
    # Equal vectors share a key: their places in the input part them.
    keyed = keyed.withColumn("place", F.monotonically_increasing_id())
    n = rows.count()
    parts = min(MOST_PARTS, max(1, -(-n // block_rows)))
    ordered = keyed.repartitionByRange(parts, "key", "place").sortWithinPartitions("key", "place").drop("key", "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        names = ["block", "ids", "labels", "q", "low", "high", "held_labels"]
        whole = lambda v, t: lists(pa.array(v, t), [len(v)])

        def block(table: pa.Table) -> pa.RecordBatch:
            q = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            labels = table.column("label").to_numpy()
            columns = [
                pa.array([number], pa.int64()),
                whole(table.column("vec_id").to_numpy(), pa.int64()),
                whole(labels, pa.int32()),
                pa.array([q.astype(np.int32).tobytes()]),
                whole(q.min(axis=0), pa.int32()),
                whole(q.max(axis=0), pa.int32()),
                whole(np.unique(labels), pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, block_rows))
                number, count = number + 1, count - block_rows
                held = table.slice(block_rows).to_batches()
        if count:
            yield block(pa.Table.from_batches(held))

    schema = "block long, ids array<long>, labels array<int>, q binary, low array<int>, high array<int>, held_labels array<int>"
    return staged(ordered.mapInArrow(cut, schema), "negative-blocks")


def _best(owners: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of every owner by falling score, then id."""
    order = np.lexsort((ids, -scores, owners))
    starts = np.concatenate([[True], owners[order][1:] != owners[order][:-1]]) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[rank < k]


def _anchors(table: DataFrame, size: int, every: int, positives: int) -> DataFrame:
    """(anchor, id, label, q, low): every anchor, and the score of its last positive so far, by its own block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = _list(batch, "ids", at), _list(batch, "labels", at)
                own = np.nonzero(ids % every == 0)[0]
                q = _numbers(batch.column("q")[at], size)
                scores = inner(q[own], q)
                fits = (labels[own, None] == labels) & (ids[own, None] != ids)
                scores = np.sort(np.where(fits, scores, -_ANY), axis=1)
                low = scores[:, -positives] if scores.shape[1] >= positives else np.full(len(own), -_ANY)
                columns = [
                    pa.array(ids[own]),
                    pa.array(labels[own]),
                    _bytes_array(q[own].view(np.uint8).reshape(len(own), -1)) if len(own) else pa.array([], pa.binary()),
                    pa.array(low),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "q", "low"])

    found = table.select("ids", "labels", "q").mapInArrow(each, "id long, label int, q binary, low long")
    return staged(found.withColumn("anchor", F.monotonically_increasing_id()), "anchors")  # fixed by being written


def _groups(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors (anchor, id, label, q, lows, highs) packed into rows, each of ``GROUP`` at most."""
    parallel = anchors.sparkSession.sparkContext.defaultParallelism
    spread = anchors.repartition(max(-(-n // GROUP), min(parallel, -(-n // 64)), 1), "anchor")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                number = lambda name, kind: lists(pa.array(part.column(name).to_numpy(), kind), [part.num_rows])
                flat = lambda name: lists(part.column(name).flatten(), [len(part.column(name).flatten())])
                columns = [
                    number("anchor", pa.int64()), number("id", pa.int64()), number("label", pa.int32()),
                    pa.array([b"".join(part.column("q").to_pylist())]), flat("lows"), flat("highs"),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["anchors", "ids", "labels", "q", "lows", "highs"])

    ordered = spread.select("anchor", "id", "label", "q", "lows", "highs")
    return ordered.mapInArrow(each, _ANCHORS)


def _needed(same: bool, a, labels, lows, highs, low, high, held) -> np.ndarray:
    """Which anchors (rows) need which blocks (columns)."""
    least, most = bounds(a, low, high)
    meets = np.zeros(least.shape, bool)
    for w in range(lows.shape[1]):
        meets |= (most >= lows[:, w, None]) & (least <= highs[:, w, None]) & (lows[:, w, None] <= highs[:, w, None])
    counts = np.array([len(h) for h in held])
    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), counts)
    for label in np.unique(labels):
        has = np.zeros(len(held), bool)
        has[owner[flat == label]] = True
        meets[labels == label] &= has if same else ~has | (counts > 1)
    return meets


def _asked(groups: DataFrame, table: DataFrame, n_blocks: int, size: int, windows: int, same: bool) -> DataFrame:
    """(block, anchors, ...): the anchors of a group that need a block, by its zone map."""
    chunks, salts = max(1, -(-n_blocks // ZONES)), 16
    zones = table.select(
        F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"), "block", "low", "high", "held_labels"
    )
    packed = zones.groupBy("chunk").agg(F.collect_list(F.struct("block", "low", "high", "held_labels")).alias("zones"))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = groups.withColumn("salt", F.pmod(F.xxhash64(F.get("anchors", F.lit(0))), F.lit(salts)).cast("int"))
    salted = salted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    names = ["block", "anchors", "ids", "labels", "q", "lows", "highs"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a = _numbers(batch.column("q")[at], size)
                held = {name: _list(batch, name, at) for name in ("anchors", "ids", "labels")}
                lows, highs = (_list(batch, name, at).reshape(-1, windows) for name in ("lows", "highs"))
                zone = batch.column("zones")[at].values
                side = lambda name: zone.field(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                of_block = [v.values.to_numpy(zero_copy_only=False) for v in zone.field("held_labels")]
                need = _needed(same, a, held["labels"], lows, highs, side("low"), side("high"), of_block)
                for block, wanted in zip(zone.field("block").to_pylist(), need.T, strict=True):
                    if wanted.any():
                        own = [pa.array([block], pa.int64())]
                        own += [lists(pa.array(held[name][wanted]), [int(wanted.sum())]) for name in ("anchors", "ids", "labels")]
                        own.append(pa.array([a[wanted].tobytes()]))
                        own += [lists(pa.array(v[wanted].ravel()), [int(wanted.sum()) * windows]) for v in (lows, highs)]
                        yield pa.RecordBatch.from_arrays(own, names=names)

    return salted.join(packed, ["chunk", "salt"]).mapInArrow(each, f"block long, {_ANCHORS}")


def _scored(asked: DataFrame, table: DataFrame, size: int, windows: int, k: int, same: bool) -> DataFrame:
    """(anchor, w, vec_id, score): of each block and window, the best ``k`` rows of an anchor."""
    joined = asked.join(table.select("block", F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("q").alias("c_q")), "block")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = _list(batch, "c_ids", at), _list(batch, "c_labels", at)
                vectors, a = (_numbers(batch.column(name)[at], size) for name in ("c_q", "q"))
                anchors, own_ids, own_labels = (_list(batch, name, at) for name in ("anchors", "ids", "labels"))
                lows, highs = (_list(batch, name, at).reshape(-1, windows) for name in ("lows", "highs"))
                for start in range(0, len(a), SLICE):
                    part = slice(start, start + SLICE)
                    scores = inner(a[part], vectors)
                    fits = (own_labels[part, None] == labels) == same
                    fits &= own_ids[part, None] != ids
                    for w in range(windows):
                        hit = fits & (scores >= lows[part, w, None]) & (scores <= highs[part, w, None])
                        owner, row = np.nonzero(hit)
                        if len(owner):
                            best = _best(owner, scores[owner, row], ids[row], k)
                            owner, row = owner[best], row[best]
                            columns = [
                                pa.array(anchors[part][owner]), pa.array(np.full(len(owner), w, np.int32)),
                                pa.array(ids[row]), pa.array(scores[owner, row]),
                            ]
                            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "w", "vec_id", "score"])

    found = joined.mapInArrow(each, "anchor long, w int, vec_id long, score long")
    ranked = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    band: tuple[int, int] = (50, 95),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vec_id, embedding, label``.

    Anchors are the rows whose vec_id is divisible by ``every``. Their ``positives`` best rows of the same label come
    with the ``negatives`` best rows of another label whose score is within ``band`` percent of the positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    nothing = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    rows = doubles(vectors, "label").where("vec_id is not null and label is not null")
    size = common_length(rows, _largest(1))
    if size is None:
        return nothing
    rows = rows.where(fault(size, _largest(size)).isNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.transform("embedding", lambda x: F.floor(x * F.lit(float(SCALE))).cast("int")).alias("q"),
    )
    if rows.isEmpty():
        return nothing
    table = blocks(rows, size, block_rows)
    anchors = _anchors(table, size, every, positives)
    n_blocks, n = table.count(), anchors.count()
    if not n:
        return nothing

    def meet(windowed: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
        asked = _asked(_groups(windowed, n), table, n_blocks, size, windows, same)
        return _scored(asked, table, size, windows, k, same)

    first = anchors.withColumns({"lows": F.array("low"), "highs": F.array(F.lit(_ANY))})
    found = staged(meet(first, 1, positives, True), "positives").select(
        "anchor", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    low = F.expr(f"-((-{band[0]} * positive_score - pmod(-{band[0]} * positive_score, 100)) div 100)")
    high = F.expr(f"({band[1]} * positive_score - pmod({band[1]} * positive_score, 100)) div 100")
    window = found.select("anchor", F.struct("w", low.alias("low"), high.alias("high")).alias("window"))
    windows = window.groupBy("anchor").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    # Anchors with fewer positives get empty windows for the rest.
    full = lambda name, other: F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("windows")[name], i), F.lit(other))
    )
    second = anchors.join(windows, "anchor").select(
        "anchor", "id", "label", "q", full("low", _ANY).alias("lows"), full("high", -_ANY).alias("highs")
    )
    mined = meet(second, positives, negatives, False)
    named = found.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return mined.join(named, ["anchor", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
