"""Per-user tables: written in hash buckets of the user, sorted within, so that a user's rows lie in one file of few.

Who reads the rows of one user opens that user's bucket alone. Tables with the same buckets meet by user, or by a key that
holds the user, bucket by bucket, without a shuffle of either. A table keeps its layout in a small file beside its data,
from which any session can open it again; it is an external table of the session's catalog.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.session import path_exists, put_if_absent, read_text

BUCKETS = 64
#: Tables in buckets of a user may meet by (user, ...) without being dealt anew by the whole key, and every scan of such a
#: table goes by its buckets.
CO_LOCATED = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def _name(path: str) -> str:
    return f"by_user_{hashlib.md5(path.encode()).hexdigest()}"


def write_by_user(
    rows: DataFrame, path: str, then: Sequence[str] = (), buckets: int = BUCKETS, user: str = "user_id"
) -> DataFrame:
    """Write ``rows`` in ``buckets`` of ``user``, sorted by it and ``then``, and open them. ``path`` must be new.

    A bucket is one file and one task, so take so many that a bucket of even users fits one; a single user who fills
    more than that belongs to a table without this layout.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    if path_exists(spark, path):
        raise FileExistsError(path)
    order = [user, *then]
    # Dealt like the buckets, so each task writes one file.
    dealt = rows.repartition(buckets, user)
    dealt.write.bucketBy(buckets, user).sortBy(*order).option("path", path).saveAsTable(_name(path))
    put_if_absent(spark, f"{path}/_layout.json", json.dumps({"user": user, "order": order, "buckets": buckets, "schema": rows.schema.json()}))
    return open_by_user(spark, path)


def open_by_user(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_by_user`` wrote, with its buckets known to the planner."""
    path = path.rstrip("/")
    name = _name(path)
    if not spark.catalog.tableExists(name):
        said = json.loads(read_text(spark, f"{path}/_layout.json"))
        fields = json.loads(said["schema"])["fields"]
        columns = ", ".join(f"`{f['name']}` {f['type']}" for f in fields)
        order = ", ".join(f"`{c}`" for c in said["order"])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{said['user']}`) SORTED BY ({order}) "
            f"INTO {said['buckets']} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def co_located(spark: SparkSession) -> None:
    """Let this session join tables in the same buckets of a user by any key that holds the user, without a shuffle."""
    for name, value in CO_LOCATED.items():
        spark.conf.set(name, value)


def of_user(table: DataFrame, user: str, column: str = "user_id") -> DataFrame:
    """One user's rows: one bucket is opened."""
    return table.where(F.col(column) == F.lit(user))
