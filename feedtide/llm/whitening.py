"""Embedding whitening by pivoted Cholesky and one-sided Jacobi (operator 11).

Every entry c becomes the whole number x = floor(64 c) + 1000000. The fit list, each distinct vector once, is written to
the shared folder; one pass adds up its exact sums, a second the products of the centred vectors. Both add up inside
tasks and return d, or d (d + 1) / 2, numbers a task, which Spark's aggregates add; the driver sees one d x d matrix,
whatever the number of rows. There the scatter is factored by Cholesky with the largest remaining diagonal entry as
pivot, P' A P = L L', and the columns of L are turned against each other, two at a time, until all are orthogonal: with
W = L J, A = W W', so the squared norms of W's columns are eigenvalues and the columns, made unit vectors, are
components. No product L'L is formed, which would square the condition number. A third pass measures the covariance of
the whitened fit list; the last one projects the rows.

Defined results: rows with a null vector, or one that holds null or non-finite entries, take no part; nor do empty
vectors, entries beyond 2^55, whose x or sums need not fit, and vectors of another length than the commonest (the
shorter on a tie), since they share no space with the rest: ``left_out`` lists all of these with the reason. Rows that
share a vec_id, or have none, are rows of their own. Components whose eigenvalue is 0 to rounding (as many as the fit
list lacks dimensions) have no unit variance to scale to and are left out, so one distinct vector gives no rows. A
deviation beyond a long is null in ``deviation``; ``deviation_text`` has all digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.llm.common import lists, small_batches
from feedtide.llm.vectors import common_length, doubles, fault, matrix
from feedtide.session import staged

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
_LARGEST = float(2**55)


def left_out(vectors: DataFrame) -> DataFrame:
    """(vec_id, reason) of the rows that take no part."""
    rows = doubles(vectors)
    reason = fault(common_length(rows, _LARGEST), _LARGEST)
    return rows.select("vec_id", reason.alias("reason")).where("reason is not null")


def whole_numbers(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    x = F.transform("embedding", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT))
    return doubles(vectors).where(fault(size, _LARGEST).isNull()).select("vec_id", x.alias("x"))


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums a dimension; halves of 32 bits are added apart, so nothing overflows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = matrix(batch, "x")
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            d = len(high)
            columns = [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "high", "low"])

    total = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    parts = fit.mapInArrow(each, "i int, n long, high long, low long")
    rows = parts.groupBy("i").agg(total("n"), total("high"), total("low")).orderBy("i").collect()
    return int(rows[0].n), [(int(r.high) << 32) + int(r.low) for r in rows]


def _second_moments(fit: DataFrame, d: int, centred) -> np.ndarray:
    """The sum of v v' over the fit list, where ``centred`` makes rows v of width ``d`` of whole numbers."""
    upper = np.triu_indices(d)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            v = centred(matrix(batch, "x"))
            total += v.T @ v
        columns = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "s"])

    made = fit.mapInArrow(each, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((d, d))
    i, j = made["i"].to_numpy(), made["j"].to_numpy()
    total[i, j] = total[j, i] = made["s"].to_numpy()
    return total


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, lower): ``a[pivots][:, pivots] = lower @ lower.T``; as many columns as ``a`` has rank, to rounding."""
    a, d = a.copy(), len(a)
    pivots, lower = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        best = k + int(np.argmax(a.diagonal()[k:]))
        if a[best, best] <= floor:
            return pivots, lower[:, :k]
        for rows in (a, a.T, lower, pivots):
            rows[[k, best]] = rows[[best, k]]
        lower[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        rest = lower[k + 1 :, k]
        a[k + 1 :, k + 1 :] -= np.outer(rest, rest)
    return pivots, lower


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times the rotations that make its columns orthogonal, largest first.

    A round turns disjoint pairs of columns at once; the rounds of a sweep, as in a round-robin tournament, meet every
    pair. The last sweep finds every pair orthogonal to rounding.
    """
    w = factor.copy()
    width = w.shape[1]
    players = np.arange(width + width % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(players) - 1, 0)):
            half = len(players) // 2
            p, q = players[:half], players[half:][::-1]
            real = (p < width) & (q < width)
            p, q = p[real], q[real]
            a, b = w[:, p], w[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            some = np.abs(ab) > 4 * np.finfo(float).eps * np.sqrt(aa * bb)
            if some.any():
                turned = True
                p, q, a, b = p[some], q[some], a[:, some], b[:, some]
                zeta = (bb[some] - aa[some]) / (2 * ab[some])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                w[:, p], w[:, q] = c * a - c * t * b, c * t * a + c * b
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if not turned:
            break
    norms = (w * w).sum(axis=0)
    return w[:, np.argsort(-norms, kind="stable")]


@dataclass(frozen=True)
class Whitening:
    """Sums of a fit list of ``n`` vectors, eigenvalues of its covariance, and components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; whole numbers are taken off first, so that no digit of a large mean is lost."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n for s in self.sums], dtype=float) / self.n
        return (x - whole).astype(float) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sums of (n x - S)^2."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n for s in self.sums])
        small = x - whole
        most = (float(np.abs(small).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2**62:
            return ((small * self.n - rest) ** 2).sum(axis=1).tolist()
        exact = small.astype(object) * self.n - rest.astype(object)
        return (exact * exact).sum(axis=1).tolist()


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of ``vec_id, embedding``; None if no row takes part."""
    small_batches(vectors.sparkSession)
    size = common_length(doubles(vectors), _LARGEST)
    if size is None:
        return None
    distinct = staged(whole_numbers(vectors, size).select("x").distinct(), "fit-list")
    n, sums = _sums(distinct)
    bare = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    scatter = _second_moments(distinct, size, bare.centred)
    pivots, lower = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(lower)
    values = (turned * turned).sum(axis=0)
    known = values > size * np.finfo(float).eps * values.max(initial=0.0)
    values, turned = values[known][:components], turned[:, known][:, :components]
    unit = np.zeros_like(turned)
    unit[pivots] = turned / np.sqrt(values)
    made = Whitening(n, sums, values / n, unit, float(scatter.trace()) / n)
    width = unit.shape[1]
    if not width:
        return made
    covariance = _second_moments(distinct, width, made.project) / n
    error = float(np.abs(covariance - np.eye(width)).max())
    return Whitening(n, sums, values / n, unit, made.trace, error)


def transform(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """One row a vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error, ...)."""
    schema = (
        f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, deviation long, deviation_text string, "
        "whitened array<double>"
    )
    spark = vectors.sparkSession
    small_batches(spark)
    empty = model is None or not len(model.values)
    size = 0 if model is None else len(model.sums)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "x")
            made, far = model.project(x), model.deviations(x)
            columns = [
                batch.column(0),
                pa.array([v if v < 2**63 else None for v in far], pa.int64()),
                pa.array([str(v) for v in far]),
                lists(made.ravel(), np.full(len(x), made.shape[1])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "deviation_text", "whitened"])

    if empty:
        rows = spark.createDataFrame([], schema)
        shares, n, error = [], 0, 0.0
    else:
        rows = whole_numbers(vectors, size).mapInArrow(each, schema)
        shares, n, error = (model.values / model.trace).tolist(), model.n, model.identity_error
    share = F.array(*[F.lit(s) for s in shares]) if shares else F.array().cast("array<double>")
    spread = rows.select("vec_id", "deviation", "deviation_text", F.posexplode("whitened").alias("i", "whitened"))
    return spread.select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("i")).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_text",
    )


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``transform`` by the whitening fitted to the same rows."""
    return transform(vectors, fit(vectors, components))
