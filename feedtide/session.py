"""Session helpers: the few settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Settings that hold on a laptop and on a cluster alike. Shuffle widths are left
# to the deployment (see README): AQE coalesces a generous initial number.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "feedtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a
    folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="feedtide-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/feedtide-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the application's scratch folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder the library wrote, wherever the shared folder lives."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return [f.getPath().getName() for f in files]


def _file_system(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    fs, target = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def modified_at(spark: SparkSession, path: str) -> float:
    """When a folder or one of its files last changed, in seconds since 1970."""
    fs, target = _file_system(spark, path)
    times = [fs.getFileStatus(target).getModificationTime()]
    times += [f.getModificationTime() for f in fs.listStatus(target)]
    return max(times) / 1000


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with this text, whole from its first moment; False if the path is taken.

    Local files are linked into place, others renamed, which object stores and HDFS refuse where a file is. A store
    whose rename replaces files can't be used by several writers at once.
    """
    fs, target = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    draft = f"{path}.{uuid.uuid4().hex}"
    _, draft_path = _file_system(spark, draft)
    stream = fs.create(draft_path, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(local(target), local(draft_path))
            return True
        return not fs.exists(target) and fs.rename(draft_path, target)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(draft_path, False)


#: What an Arrow batch may hold where rows carry blocks of numbers.
BATCH_BYTES = 8 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of this session's Arrow batches, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application staged. Call it when the job is done with its results."""
    delete_path(spark, scratch_dir(spark))


def checkpointed(df, eager: bool = True):
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=eager)


def staged(df, label: str, path: str | None = None):
    """Write ``df`` once as parquet below the shared folder and read it back.

    For results that several branches read: each branch then scans only its own
    columns, nothing is computed twice, and a lost executor costs no recomputation.
    """
    path = path or fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
