"""Nearest neighbours from randomly rotated one-bit codes (operator 9).

Vectors are scaled to length one, moved to the middle of the collection, rotated at random, and kept as the signs of
their coordinates: one bit a dimension, and two scalars, the length and how well the signs point the vector's way. The
inner product of a query with such a code estimates the true one, with an error that is beyond ``EPSILON`` standard
bounds in about one case of a thousand. Within a block of codes, the queries keep the vectors whose upper bound reaches
the lower bound of the k-th best, and compare those with the original vectors.

The stated queries meet all rows in blocks: vectors and queries are hashed into blocks, every pair of blocks is one
task's work and returns k rows a query, whose best k are found by an aggregate. No row pair becomes a row of Spark.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries
nor as candidates; nor do rows without a vec_id or with another dimension than the queries'. Rows that share a vec_id
are one candidate each; a query never finds rows of its own vec_id. Ties go to the smaller vec_id. Cosines are summed
dimension by dimension in double precision, so equal vectors give equal scores; vectors of components beyond 1e70, or all
below 1e-70, are scaled by a power of two first, so any finite vector has its cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries.
CANDIDATE_BLOCK = 25_000
QUERY_BLOCK = 2_000
EPSILON = 3.0


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine & some)
    # Squares of very large or small components leave the range of doubles. A power of two changes no cosine and no digit.
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    far = F.when(largest > 1e70, F.lit(2.0**-600)).when(largest < 1e-70, F.lit(2.0**600))
    near = F.pow(F.lit(2.0), -F.floor(F.log2(largest * far)).cast("double"))  # takes the largest to between 1 and 2
    scaled = F.when(far.isNotNull(), F.transform("embedding", lambda x: x * far * near)).otherwise(F.col("embedding"))
    return rows.withColumn("embedding", scaled)


def rotation(dimensions: int, seed: int = 11) -> np.ndarray:
    """A random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of unit vectors about ``middle``."""

    def __init__(self, unit: np.ndarray, middle: np.ndarray, turn: np.ndarray):
        moved = (unit - middle) @ turn
        size = moved.shape[1]
        self.length = np.linalg.norm(moved, axis=1)
        self.bits = np.packbits(moved > 0, axis=1)
        signs = np.where(moved > 0, 1.0, -1.0) / np.sqrt(size)
        # The cosine between a vector and its code: the estimator divides by it.
        self.fit = (moved * signs).sum(axis=1) / np.maximum(self.length, 1e-300)
        self.fit[self.length < 1e-12] = 1.0
        self.size = size

    def bounds(self, unit: np.ndarray, middle: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of ``unit`` queries (rows) with the coded vectors (columns), and error bounds."""
        query = (unit - middle) @ turn
        length = np.linalg.norm(query, axis=1)
        signs = np.unpackbits(self.bits, axis=1, count=self.size).astype(np.float32) * 2 - 1
        toward = (query.astype(np.float32) @ signs.T) / np.sqrt(self.size)
        moved = toward / self.fit * self.length
        # <o, q> = <o - c, q - c> + <o, c> + <q, c> - <c, c>; |o| = 1 gives <o, c> from the kept length.
        with_middle = (1 - self.length**2 + middle @ middle) / 2
        estimate = moved + with_middle + (unit @ middle)[:, None] - middle @ middle
        spread = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit * EPSILON / np.sqrt(max(self.size - 1, 1))
        return estimate, length[:, None] * (spread * self.length) + 1e-5


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines with one query, summed dimension by dimension."""
    dot, square, own = np.zeros(len(vectors)), np.zeros(len(vectors)), 0.0
    for j in range(vectors.shape[1]):
        column = vectors[:, j]
        dot += column * query[j]
        square += column * column
        own += query[j] * query[j]
    return np.clip(dot / np.sqrt(square * own), -1.0, 1.0)


def search_block(query_ids, queries, ids, vectors, middle, turn, k):
    """The best ``k`` of one block for each query: (query_id, vec_id, score) arrays."""
    found = ([], [], [])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    codes = Codes(unit, middle, turn)
    for at in range(0, len(queries), 64):
        own = queries[at : at + 64]
        estimate, error = codes.bounds(own / np.linalg.norm(own, axis=1)[:, None], middle, turn)
        # One more than k, since the query itself may be among them; a shared vec_id may need still more.
        for i, query in enumerate(own):
            other = ids != query_ids[at + i]
            low, high = (estimate[i] - error[i])[other], (estimate[i] + error[i])[other]
            rows = np.nonzero(other)[0]
            if len(rows) > k:
                rows = rows[high >= np.partition(low, len(low) - k)[-k]]
            scores = cosines(query, vectors[rows])
            best = np.lexsort((ids[rows], -scores))[:k]
            found[0].append(np.full(len(best), query_ids[at + i]))
            found[1].append(ids[rows[best]])
            found[2].append(scores[best])
    return [np.concatenate(f) if f else np.zeros(0) for f in found]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    base, asked = usable(vectors), usable(queries)
    counts = base.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    n_asked = asked.count()
    if counts is None or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = counts.d, counts.n
    base, asked = (rows.where(F.size("embedding") == size) for rows in (base, asked))
    # The middle: a mean of one vector a dimension, whatever the number of rows.
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    units = base.select(F.posexplode(F.transform("embedding", lambda x: x / length)).alias("i", "x"))
    middle = np.array([r.m for r in units.groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()])
    turn = rotation(size, seed)
    candidate_blocks, query_blocks = -(-n // CANDIDATE_BLOCK), -(-n_asked // QUERY_BLOCK)
    # Every candidate goes to each query block and every query to each candidate block.
    block = lambda count: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = base.select("vec_id", "embedding", block(candidate_blocks).alias("c")).withColumn("q", every(query_blocks))
    right = asked.select("vec_id", "embedding", block(query_blocks).alias("q")).withColumn("c", every(candidate_blocks))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), flat.reshape(-1, size)

    def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
        made = [np.zeros(0)] * 3
        if rows.num_rows and asking.num_rows:
            made = search_block(*matrix(asking), *matrix(rows), middle, turn, k)
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(m, t) for m, t in zip(made, types)], names=["query_id", "vec_id", "score"])

    local = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(meet, schema)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
