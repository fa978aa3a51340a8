"""Tables as a log of commits: versions that several writers may publish, and keyed deltas merged when read.

A table is a folder of finished Parquet folders and a log. Entry ``n`` of the log is a small file that names the base
folder and the delta folders that make up version ``n``. It is put in place whole, and only where no entry ``n`` is
(``put_if_absent``), so of two writers that have both seen version n - 1 one wins; the other reads the winner's version
and tries again on top of it. Folders have random names and are never changed, so no writer touches another's work.

A delta holds whole rows of some keys, and replaces or (``_gone``) deletes them. Readers join the base against the keys
of the deltas, which is a map-side join as long as the deltas are small, and a later delta wins over an earlier one.
Once the deltas hold more than a share of the base's bytes they are folded into a new base.

A table without keys can be appended to: parts are added to its base, and folded into it when there are many. It may be
cut into hash slots, which are Parquet partitions, so that readers of a few keys open the files of few slots.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedtide.session import child_names, delete_path, folder_bytes, modified_at, path_exists, put_if_absent, read_text

GONE, SLOT = "_gone", "_slot"
#: Hash slots of a table, and parts that one may have before they are folded.
SLOTS, MOST_PARTS = 64, 32
DAY = 24 * 3600.0
ATTEMPTS = 100


class Conflict(RuntimeError):
    """The table has changed since the version that an update was computed from."""


@dataclass(frozen=True)
class Version:
    """What a log entry says. ``marks`` are the last batches taken in from streams, by their name."""

    number: int = 0
    base: str | None = None
    deltas: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    marks: dict[str, int] = field(default_factory=dict)
    at: float = 0.0
    schema: str | None = None  # of a table that is appended to: a part may be empty


def _entries(spark: SparkSession, path: str) -> list[int]:
    folder = f"{path}/_log"
    if not path_exists(spark, folder):
        return []
    return sorted(int(n[:-5]) for n in child_names(spark, folder) if n.endswith(".json") and n[:-5].isdigit())


def _entry(path: str, number: int) -> str:
    return f"{path}/_log/{number:012d}.json"


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version of a table, or one of its earlier ones; number 0 if nothing is published yet."""
    path = path.rstrip("/")
    if number is None:
        number = max(_entries(spark, path), default=0)
        if not number:
            return Version()
    said = json.loads(read_text(spark, _entry(path, number)))
    return Version(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})


def commit(spark: SparkSession, path: str, change: Callable[[Version], Version | None]) -> Version:
    """Publish ``change`` of the newest version; tried again on top of whatever others publish meanwhile.

    ``change`` returns None, or raises, when there is nothing to publish on top of that version.
    """
    path = path.rstrip("/")
    for _ in range(ATTEMPTS):
        last = version(spark, path)
        new = change(last)
        if new is None:
            return last
        new = changed(new, number=last.number + 1, at=time.time())
        if put_if_absent(spark, _entry(path, new.number), json.dumps(asdict(new))):
            return new
    raise Conflict(f"{path}: {ATTEMPTS} other commits came first")


def slot(column: str | Column, slots: int = SLOTS) -> Column:
    """The hash slot of a key."""
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")


def _write(rows: DataFrame, path: str, kind: str) -> str:
    name = f"{kind}-{uuid.uuid4().hex}"
    cut = [SLOT] if SLOT in rows.columns else []
    rows.write.partitionBy(*cut).parquet(f"{path}/{name}")
    return name


def replace(rows: DataFrame, path: str, keys: Sequence[str] = (), older_than: float = DAY) -> Version:
    """Publish ``rows`` as the whole table; they may read the version they replace.

    ``keys`` name one row at most, for the deltas to come. Folders that no version younger than ``older_than`` seconds
    names are deleted afterwards.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    base = _write(rows, path, "base")
    new = commit(spark, path, lambda last: Version(base=base, keys=tuple(keys), marks=last.marks))
    clean(spark, path, older_than)
    return new


def upsert(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    based_on: Version | None = None,
    mark: tuple[str, int] | None = None,
    compact_at: float | None = 0.25,
) -> Version:
    """Publish whole rows of some keys, one row a key; rows whose ``_gone`` is true delete theirs.

    ``based_on`` is the version that the rows were computed from, if they were: ``Conflict`` if another came since.
    ``mark`` (name, batch) makes a stream's batch count once, however often it is tried.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    if taken_in(spark, path, mark):
        return version(spark, path)
    if GONE not in rows.columns:
        rows = rows.withColumn(GONE, F.lit(False))
    delta = _write(rows, path, "delta")

    def add(last: Version) -> Version | None:
        if based_on is not None and based_on.number != last.number:
            delete_path(spark, f"{path}/{delta}")
            raise Conflict(f"{path}: version {last.number} came after {based_on.number}")
        if last.keys and last.keys != tuple(keys):
            raise ValueError(f"{path} is keyed by {last.keys}, not {tuple(keys)}")
        if mark and last.marks.get(mark[0], -1) >= mark[1]:
            return None
        marks = last.marks | ({mark[0]: mark[1]} if mark else {})
        return changed(last, deltas=(*last.deltas, delta), keys=tuple(keys), marks=marks)

    new = commit(spark, path, add)
    if compact_at is not None and delta_share(spark, path, new) > compact_at:
        new = compact(spark, path)
    return new


def append(rows: DataFrame, path: str, mark: tuple[str, int] | None = None, most_parts: int = MOST_PARTS) -> Version:
    """Add rows to a table without keys. A column ``_slot`` cuts it into partitions. ``mark`` as in ``upsert``."""
    spark, path = rows.sparkSession, path.rstrip("/")
    if taken_in(spark, path, mark):
        return version(spark, path)
    part = _write(rows, path, "part")

    def add(last: Version) -> Version | None:
        if last.keys:
            raise ValueError(f"{path} is keyed by {last.keys}")
        if mark and last.marks.get(mark[0], -1) >= mark[1]:
            return None
        marks = last.marks | ({mark[0]: mark[1]} if mark else {})
        return changed(last, parts=(*last.parts, part), marks=marks, schema=last.schema or rows.schema.json())

    new = commit(spark, path, add)
    return compact(spark, path) if len(new.parts) > most_parts else new


def taken_in(spark: SparkSession, path: str, mark: tuple[str, int] | None) -> bool:
    """Whether a stream's batch is in the table already."""
    return mark is not None and version(spark, path).marks.get(mark[0], -1) >= mark[1]


def update(path: str, spark: SparkSession, keys: Sequence[str], rows_of: Callable[[DataFrame], DataFrame], **options) -> Version:
    """Publish ``rows_of`` the current table as a delta; computed anew if another writer publishes meanwhile."""
    for _ in range(ATTEMPTS):
        seen = version(spark, path)
        try:
            return upsert(rows_of(read(spark, path, seen)), path, keys, based_on=seen, **options)
        except Conflict:
            continue
    raise Conflict(f"{path}: {ATTEMPTS} other commits came first")


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    return functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _newest(spark: SparkSession, path: str, of: Version) -> DataFrame:
    """One row a key over all deltas, deletions included."""
    parts = [spark.read.parquet(f"{path}/{d}").withColumn("_order", F.lit(i)) for i, d in enumerate(of.deltas)]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(parts) == 1:
        return rows.drop("_order")
    rest = [c for c in rows.columns if c not in (*of.keys, "_order")]
    last = F.max_by(F.struct(*rest), F.col("_order")).alias("_row")
    return rows.groupBy(*of.keys).agg(last).select(*of.keys, "_row.*")


def read(spark: SparkSession, path: str, of: Version | int | None = None) -> DataFrame:
    """The rows of a version, the newest one if not said."""
    path = path.rstrip("/")
    of = of if isinstance(of, Version) else version(spark, path, of)
    if of.base is None and not of.deltas and not of.parts:
        raise FileNotFoundError(f"no table has been published at {path}")
    reader = spark.read.schema(StructType.fromJson(json.loads(of.schema))) if of.schema else spark.read
    whole = [reader.parquet(f"{path}/{f}") for f in ([of.base] if of.base else []) + list(of.parts)]
    base = functools.reduce(lambda a, b: a.unionByName(b), whole) if whole else None
    if not of.deltas:
        return base
    newest = _newest(spark, path, of)
    kept = newest.where(~F.col(GONE)).drop(GONE)
    if base is None:
        return kept
    return base.join(newest, _same(of.keys, base, newest), "left_anti").unionByName(kept, allowMissingColumns=True)


def changed_keys(spark: SparkSession, path: str, of: Version) -> DataFrame | None:
    """Rows of the deltas of a version, one a key, with ``_gone``; None if it has none."""
    return _newest(spark, path.rstrip("/"), of) if of.deltas else None


def delta_share(spark: SparkSession, path: str, of: Version) -> float:
    """Bytes of the deltas of a version, as a share of its base's."""
    path = path.rstrip("/")
    deltas = sum(folder_bytes(spark, f"{path}/{d}") for d in of.deltas)
    base = folder_bytes(spark, f"{path}/{of.base}") if of.base else 0
    return deltas / base if base else float(deltas > 0)


def compact(spark: SparkSession, path: str) -> Version:
    """Fold the deltas of the newest version into a new base. Deltas that others add meanwhile stay on top of it."""
    path = path.rstrip("/")
    seen = version(spark, path)
    if not seen.deltas and not seen.parts:
        return seen
    base = _write(read(spark, path, seen), path, "base")

    def fold(last: Version) -> Version | None:
        n, m = len(seen.deltas), len(seen.parts)
        if last.base != seen.base or last.deltas[:n] != seen.deltas or last.parts[:m] != seen.parts:
            return None  # another base was published: it stands
        return changed(last, base=base, deltas=last.deltas[n:], parts=last.parts[m:])

    new = commit(spark, path, fold)
    if new.base != base:
        delete_path(spark, f"{path}/{base}")
    return new


def clean(spark: SparkSession, path: str, older_than: float = DAY) -> list[str]:
    """Delete what has been of no use for ``older_than`` seconds; the names of the folders deleted.

    The newest version stays, as do all that were the newest at some time in that span, and every folder changed in it:
    it may be another writer's, finished or not. So the span must exceed the longest write and the longest read.
    """
    path, oldest = path.rstrip("/"), time.time() - older_than
    numbers = _entries(spark, path)
    versions = [version(spark, path, n) for n in numbers]
    ended = [v.at for v in versions[1:]] + [float("inf")]  # when the next one came
    kept = [v for v, end in zip(versions, ended) if end > oldest]
    named = {name for v in kept for name in (v.base, *v.deltas, *v.parts)}
    gone = []
    for name in child_names(spark, path):
        if name.startswith(("base-", "delta-", "part-")) and name not in named and modified_at(spark, f"{path}/{name}") < oldest:
            delete_path(spark, f"{path}/{name}")
            gone.append(name)
    for v in versions:
        if v not in kept:
            delete_path(spark, _entry(path, v.number))
    return gone
