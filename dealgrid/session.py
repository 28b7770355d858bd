"""Session settings, shared scratch folders and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: str | int = "*", app: str = "dealgrid", partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("DEALGRID_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders that this process has handed out and not cleared.
_SCRATCH: set[str] = set()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="dealgrid-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for `name` below the shared folder the cluster names.

    Only a local session may fall back to a folder of this machine: on a cluster the executors
    could not see it, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_folder()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def task_folder(spark: SparkSession, path: str) -> str | None:
    """The URI of a folder that tasks can list, read and write by themselves; None if it isn't there, is a pattern, or lies where only Spark reaches it."""
    import pyarrow as pa
    from pyarrow import fs

    if set(path) & set("{}[]*?\\"):
        return None
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().toString()
    if uri.partition(":")[0] not in ("file", "hdfs"):
        return None
    try:
        system, inner = fs.FileSystem.from_uri(uri)
        return uri if system.get_file_info(inner).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders handed out so far; returns how many there were.

    For the end of a job, when its results are written: frames that were read from scratch can't be read after it.
    """
    conf = spark._jsc.hadoopConfiguration()
    found = 0
    for path in sorted(_SCRATCH):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found += bool(folder.getFileSystem(conf).delete(folder, True))
        _SCRATCH.discard(path)
    return found


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What opening a small file is taken to cost in bytes read, and the committer whose tasks move their own files into place.
OPEN_COST = {"spark.sql.files.openCostInBytes": str(64 << 10)}
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads hundreds of small files in a task; by default each counts as 4 MB, and a task gets a few."""
    before = {k: spark.conf.get(k) for k in OPEN_COST}
    for k, v in OPEN_COST.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bounded_count(df: DataFrame, max_rows: int) -> int:
    """Rows of a frame, counted no further than one past `max_rows`."""
    return df.select(F.lit(1)).limit(max_rows + 1).count()


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> tuple[DataFrame, bool]:
    """Hint a broadcast only when a bounded count proves that the side fits.

    Returns the (possibly hinted) frame and whether it fits, so the caller can take another way
    for a larger side.
    """
    fits = bounded_count(df, max_rows) <= max_rows
    return (F.broadcast(df) if fits else df), fits
