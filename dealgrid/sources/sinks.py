"""Writers: registries, first loads, forecast snapshots and the sync log."""

from __future__ import annotations

import re

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from dealgrid.session import BY_TASKS, broadcast_if_small, task_folder

#: Files that a task writes to one folder.
FILES_PER_FOLDER = 1000
#: The name of a null, and characters that names hold as %XX, as Spark's writers have it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


class RegistryNotEmpty(Exception):
    """A first load met a registry that already has rows."""


def write_registry(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        raise ValueError(f"unknown registry format {fmt!r}")


def seed_registry(df: DataFrame, path: str) -> None:
    """First load only: a target that holds rows is refused, an empty one is filled."""
    spark = df.sparkSession
    try:
        held = spark.read.parquet(path).limit(1).count()
    except AnalysisException:
        held = 0
    if held:
        raise RegistryNotEmpty(path)
    df.write.mode("append").parquet(path)


def append_forecast_snapshot(
    position: DataFrame, path: str, cadence: str, taken_at: str, headline: str | None = None, artifact_path: str | None = None
) -> None:
    """One row per track for this date and cadence with the headline of the day, kept apart by cadence on disk."""
    row = position.withColumns({
        "taken_at": F.lit(taken_at).cast("date"), "cadence": F.lit(cadence), "headline": F.lit(headline).cast("string"),
        "artifact_path": F.lit(artifact_path).cast("string"),
    })
    row.write.mode("append").partitionBy("cadence").parquet(path)


def append_sync_log(classes: DataFrame, path: str, registry: str, synced_at: str) -> None:
    """Counts by outcome of one sync, appended to the log."""
    log = classes.groupBy(F.col("sync_class").alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
    log.withColumn("registry", F.lit(registry)).withColumn("synced_at", F.lit(synced_at).cast("timestamp")).write.mode("append").parquet(path)


def _file_writer(uri: str, name: str, part: str):
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri)
        at = TaskContext.get()
        # Hidden until it is whole: an attempt that ends early or comes second leaves no file that readers see.
        whole = f"{root}/{part}-{at.partitionId():05d}"
        own, last, out, n = f"{root}/.{part}-{at.partitionId():05d}-{at.taskAttemptId()}", None, None, 0
        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last:
                    if out:
                        out.close()
                    folder = f"{own}/{n // FILES_PER_FOLDER:05d}"
                    if n % FILES_PER_FOLDER == 0:
                        system.create_dir(folder)
                    held = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key)
                    out, last, n = system.open_output_stream(f"{folder}/{name}={held}.txt"), key, n + 1
                out.write(line)
        if out:
            out.close()
            try:
                system.move(own, whole)
            except OSError:
                if system.get_file_info(whole).type != fs.FileType.Directory:
                    raise
                system.delete_dir(own)
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return write


def write_files(df: DataFrame, key: str, text: str, path: str) -> None:
    """A text file named `key=value` for each value of a key, with a line for each row, somewhere below `path`.

    Spark's writer makes a folder and a checksum file for each file too, and starts processes for them on a local disk without native libraries; here tasks write at once,
    FILES_PER_FOLDER to a folder. Only rows of keys that repeat are moved to meet. Where only Spark reaches `path` its writer does it, and the folder has the name.
    """
    spark = df.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    base.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(base)
    uri = task_folder(spark, path)
    if uri is None:
        df.select(key, text).repartition(key).write.mode("append").partitionBy(key).options(**BY_TASKS).text(path)
        return
    named = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(NO_VALUE)).alias("key")
    lines = df.select(named, F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).cast("binary").alias("line"))
    repeated, _ = broadcast_if_small(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    once, more = lines.join(repeated, "key", "left_anti"), lines.join(repeated, "key", "left_semi")
    for part, rows in (("once", once), ("more", more.repartition("key").sortWithinPartitions("key", "line"))):
        rows.mapInArrow(_file_writer(uri, key, part), "files long").agg(F.sum("files")).collect()
