"""Joins that stay balanced when one key holds a large share of the rows.

Both helpers take per-key row counts, which the callers have anyway. A key is hot
when it holds at least ``total / MAX_HOT_KEYS`` rows (and at least
``MIN_HOT_ROWS``), so there can never be more than ``MAX_HOT_KEYS`` hot keys: the
only thing that is broadcast has that many rows at most, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedtide.session import staged

MAX_HOT_KEYS = 10_000
MIN_HOT_ROWS = 200_000
#: Rows that one task of an N:M join may make of a hot key.
MAX_CELL_ROWS = 20_000_000


def hot_keys(per_key: DataFrame, count_col: str, min_rows: int | None = None) -> DataFrame:
    """The keys whose row count crosses the hot threshold (at most MAX_HOT_KEYS)."""
    floor = MIN_HOT_ROWS if min_rows is None else min_rows
    total = per_key.agg((F.sum(count_col) / F.lit(MAX_HOT_KEYS)).alias("share")).scalar()
    return per_key.where((F.col(count_col) >= F.lit(floor)) & (F.col(count_col) > F.coalesce(total, F.lit(0.0))))


def attach_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    count_col: str,
    min_rows: int | None = None,
    stage: bool = True,
) -> DataFrame:
    """Inner N:1 join of ``rows`` with one-row-per-key attributes, safe for hot keys.

    Rows of hot keys meet their attributes in a map-side join and are never
    shuffled by the key; only the evenly spread remainder is. ``per_key`` is read
    several times, so it is staged unless ``stage=False`` says it is a table already.
    """
    keys = list(keys)
    if stage:
        per_key = staged(per_key, "per-key")
    hot = hot_keys(per_key, count_col, min_rows)
    hot_names = hot.select(*keys)
    of_hot = rows.join(F.broadcast(hot), keys, "inner")
    of_cold = rows.join(F.broadcast(hot_names), keys, "left_anti").join(
        per_key.join(F.broadcast(hot_names), keys, "left_anti"), keys, "inner"
    )
    return of_hot.unionByName(of_cold)


def _salt_counts(sizes: DataFrame, keys: list[str], count_col: str, name: str, min_rows: int | None) -> DataFrame:
    """(keys, name): salts of the hot keys only, a bounded table to broadcast."""
    floor = MIN_HOT_ROWS if min_rows is None else min_rows
    return F.broadcast(
        hot_keys(sizes, count_col, floor).select(
            *keys, F.ceil(F.col(count_col) / F.lit(floor)).cast("int").alias(name)
        )
    )


def _salt_grid(
    left_sizes: DataFrame, right_sizes: DataFrame, keys: list[str], count_col: str, min_rows: int | None
) -> DataFrame:
    """(keys, _left_salt, _right_salt): how a key whose two sides meet in very many rows is cut.

    A cell of the grid makes about ``MAX_CELL_ROWS`` rows, however its key's rows are shared out between the sides. At
    most ``MAX_HOT_KEYS`` keys make that share of all rows, so the table is broadcast.
    """
    limit = float(MAX_CELL_ROWS if min_rows is None else min_rows)
    made = left_sizes.select(*keys, F.col(count_col).cast("double").alias("_l")).join(
        right_sizes.select(*keys, F.col(count_col).cast("double").alias("_r")), keys
    )
    made = staged(made.withColumn("_out", F.col("_l") * F.col("_r")), "join-sizes")
    share = made.agg((F.sum("_out") / F.lit(MAX_HOT_KEYS)).alias("share")).scalar()
    hot = made.where((F.col("_out") > F.lit(limit)) & (F.col("_out") > F.coalesce(share, F.lit(0.0))))
    cells = F.ceil(F.col("_out") / F.lit(limit))
    left = F.least(cells, F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("_l") / F.col("_r")))))
    hot = hot.select(*keys, left.cast("int").alias("_left_salt"), cells.alias("_cells"))
    return F.broadcast(hot.withColumn("_right_salt", F.ceil(F.col("_cells") / F.col("_left_salt")).cast("int")).drop("_cells"))


def _salted(rows: DataFrame, salts: DataFrame, keys: list[str], name: str, spread_on: Sequence[Column] | None) -> DataFrame:
    """Give each row one salt by hash, or with no ``spread_on`` repeat it for every salt of its key."""
    known = rows.join(salts, keys, "left")
    n = F.coalesce(name, F.lit(1))
    if spread_on is None:
        return known.withColumn(name, F.explode(F.sequence(F.lit(0), n - 1)))
    return known.withColumn(name, F.pmod(F.xxhash64(*spread_on), n.cast("long")).cast("int"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_spread: Sequence[Column],
    left_sizes: DataFrame,
    count_col: str,
    right_spread: Sequence[Column] | None = None,
    right_sizes: DataFrame | None = None,
    how: str = "inner",
    min_rows: int | None = None,
) -> DataFrame:
    """N:M join in which the rows of hot keys spread over several tasks.

    ``left_sizes`` counts the rows of ``left`` per key in ``count_col``. Rows of
    a hot key are hashed over salts by ``left_spread``, and the matching right
    rows are repeated once per salt; all other keys have one salt. Give
    ``right_sizes`` (same ``count_col``) and ``right_spread`` to cut keys by the
    rows the join makes of them: such a key then falls into a grid of salts.
    """
    if how not in ("inner", "left") or (how == "left" and right_sizes is not None):
        raise ValueError("inner, or left with salts on the left side only")
    keys = list(keys)
    by = [*keys, "_left_salt"]
    if right_sizes is None:
        salts = _salt_counts(left_sizes, keys, count_col, "_left_salt", min_rows)
        left = _salted(left, salts, keys, "_left_salt", left_spread)
        right = _salted(right, salts, keys, "_left_salt", None)
    else:
        grid = _salt_grid(left_sizes, right_sizes, keys, count_col, min_rows)
        of_left, of_right = grid.select(*keys, "_left_salt"), grid.select(*keys, "_right_salt")
        left = _salted(_salted(left, of_left, keys, "_left_salt", left_spread), of_right, keys, "_right_salt", None)
        right = _salted(_salted(right, of_left, keys, "_left_salt", None), of_right, keys, "_right_salt", right_spread)
        by.append("_right_salt")
    return left.join(right, by, how).drop("_left_salt", "_right_salt")
