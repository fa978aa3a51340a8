"""Small helpers the training-data operators share: table reads, row keys, Arrow maps, span joins."""

from __future__ import annotations

import functools
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but the six ASCII white-space characters (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def kept_in_worker(key, make: Callable[[], object], most: int = 1):
    """What ``make`` returns, kept by ``key`` as long as the Python worker lives.

    Functions reach workers by value, so their module's variables start anew with every task; this does not.
    """
    home = sys.modules.setdefault("worker_memory_", types.ModuleType("worker_memory_")).__dict__
    if key not in home:
        held = home.setdefault("held_", [])
        while len(held) >= most:
            home.pop(held.pop(0))
        home[key] = make()
        held.append(key)
    return home[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows that no model may learn from: crc32 of the doc_id's text leaves no remainder by 5.

    A null doc_id counts as the empty text, whose crc32 is 0, so such rows are never learnt from.
    """
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_key() -> Column:
    """Tells documents apart that share a doc_id (or have none); full copies of a row share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col("text").isNull())


def hash_order(*columns: str) -> list[Column]:
    """A repeatable shuffled order for bounded samples."""
    return [F.xxhash64(*columns), *(F.col(c) for c in columns)]


def columns_apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage over documents that returns the columns it gets: others than its own are numbered while it runs.

    So no extra column can clash with a name the stage uses, nor be changed by it.
    """

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = [c if c in ("doc_id", "text", "n_chars") else f"extra{i}_" for i, c in enumerate(docs.columns)]
        made = stage(docs.toDF(*names), *args, **options)
        return made.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

    return run


#: What an Arrow batch may hold: texts differ in length by a factor of thousands.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are smaller already."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.sub("[bB]$", "", spark.conf.get(name))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


#: Bits of a map of hashes. Its size is fixed and it only spares work: an exact join follows wherever one is used.
MAP_BITS = 26


def bit_map(rows: DataFrame, column: str) -> np.ndarray:
    """A map of the leading bits of a column of 64-bit hashes; bits of one cell are or-ed before they are sent."""
    cell = F.shiftright(F.shiftrightunsigned(column, 64 - MAP_BITS), 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - MAP_BITS}) & 63 AS int))")
    cells = rows.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return bits


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which (signed) hashes may be in the map."""
    at = values.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    cells = bits.view(np.uint64)[at >> np.uint64(6)]
    return (cells >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def maybe_in(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """``rows`` less most of those whose hash is not in the map: what is not wanted isn't shuffled for a join."""
    small_batches(rows.sparkSession)
    shared, at = rows.sparkSession.sparkContext.broadcast(bits), rows.columns.index(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(in_map(shared.value, batch.column(at).to_numpy(zero_copy_only=False))))
            if kept.num_rows:
                yield kept

    return rows.mapInArrow(each, rows.schema)


def map_texts(
    docs: DataFrame,
    keep: list[str],
    schema: str,
    work: Callable[[list[str], pa.RecordBatch], list[pa.Array]],
    text: str = "text",
) -> DataFrame:
    """Run ``work`` over whole texts, one Arrow batch after another; null texts come as "".

    ``keep`` names the input columns to carry, ``schema`` the new columns that ``work`` returns.
    """
    small_batches(docs.sparkSession)
    carried = text in keep
    source = docs.select(*keep) if carried else docs.select(*keep, F.col(text).alias("text_"))
    fields = source.schema.fields if carried else source.schema.fields[:-1]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    at, n = (keep.index(text) if carried else len(keep)), len(keep)
    names = [part.split()[0].strip("`") for part in _fields(schema)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work([t or "" for t in batch.column(at).to_pylist()], batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *names])

    return source.mapInArrow(each, f"{kept}, {schema}" if kept else schema)


def _fields(schema: str) -> list[str]:
    """The top-level fields of a DDL string."""
    parts, depth, start = [], 0, 0
    for i, char in enumerate(schema):
        depth += (char in "<(") - (char in ">)")
        if char == "," and not depth:
            parts.append(schema[start:i].strip())
            start = i + 1
    return [*parts, schema[start:].strip()]


def lists(values, counts) -> pa.ListArray:
    """A list column from all values in a row and the length of each list."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
