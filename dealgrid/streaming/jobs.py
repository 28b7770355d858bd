"""Structured Streaming jobs: refresh, dedup, windows, late news, caps, expiry and drop folders.

Every job reads a file stream with a declared schema and runs with the availableNow trigger, so it can
be scheduled or left running. Checkpoints and outputs live in the shared folder. Sinks written from
`foreachBatch` use one folder per batch id and overwrite it, so a batch that is run again after a
failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dealgrid.operators import engagement, sync
from dealgrid.operators.demand import TTL_DAYS

ACTIVITY_DELAY = "2 days"
SIGNAL_DELAY = "14 days"
LONGEST_TTL_DAYS = max(TTL_DAYS.values())
DAY_MS = 86_400_000
# Parts that a level of a change log holds before they are merged.
LEVEL_PARTS = 8
ROCKS_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk and save its changes, not the whole, after each batch."""
    before = {k: spark.conf.get(k, None) for k in ROCKS_STATE}
    for k, v in ROCKS_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )


def run_once(stream: DataFrame, work: str, mode: str, sink: Callable[[DataFrame, int], None]):
    """Process all that has arrived, then stop; the checkpoint says where to go on."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True).foreachBatch(sink).start()
    )
    query.awaitTermination()
    return query


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    return write


def read_parts(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(wide).option("basePath", out).parquet(f"{out}/part=*")


def latest_of(parts: DataFrame, key: list[str]) -> DataFrame:
    """The last update of each key from a sink in update mode."""
    rest = [c for c in parts.columns if c not in (*key, "batch_id", "part")]
    return parts.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v")).select(*key, "_v.*")


def _parts(spark: SparkSession, log: str) -> list[tuple[int, int, int, str]]:
    """Finished parts of a change log as (level, first batch, last batch, path)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.startswith("L") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            level, first, last = (int(x) for x in name[1:].split("-"))
            found.append((level, first, last, f"{log}/{name}"))
    return sorted(found)


def _drop_part(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_changes(spark: SparkSession, log: str, schema: T.StructType, key: str, order: list[str]) -> DataFrame:
    """The newest change of each record over all parts of a log."""
    wide = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    paths = [path for *_, path in _parts(spark, log)]
    parts = spark.read.schema(wide).parquet(*paths) if paths else spark.createDataFrame([], wide)
    return sync.latest_record(parts, key, [*order, "batch_id"]).drop("batch_id")


def tier_log(spark: SparkSession, log: str, schema: T.StructType, key: str, order: list[str]) -> None:
    """Merge a level's oldest parts into one of the next level whenever it holds LEVEL_PARTS of them.

    A merged part keeps the newest change of each record. It is written before its sources go, and reading both gives the same, so a
    job that dies in between loses nothing. A record is rewritten once for each level, and a read meets fewer than LEVEL_PARTS parts a level.
    """
    wide = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    level = 0
    while any(part[0] >= level for part in _parts(spark, log)):
        own = [part for part in _parts(spark, log) if part[0] == level]
        for at in range(0, len(own) - LEVEL_PARTS + 1, LEVEL_PARTS):
            group = own[at : at + LEVEL_PARTS]
            merged = sync.latest_record(spark.read.schema(wide).parquet(*[path for *_, path in group]), key, [*order, "batch_id"])
            merged.select(*wide.names).write.mode("overwrite").parquet(f"{log}/L{level + 1}-{group[0][1]}-{group[-1][2]}")
            for *_, path in group:
                _drop_part(spark, path)
        level += 1


def stream_refresh(stream: DataFrame, target: DataFrame, key: str, order: list[str], ownership: Mapping[str, str], work: str) -> DataFrame:
    """Land each pull of changed records as a part of a change log and read the registry through it.

    A batch costs what it brings and never rewrites the registry; the log is kept in levels (`tier_log`), so a read merges few parts however many batches
    there were. The newest change of each record is merged field by field when the registry is read; `compact_registry` folds the log in.
    """
    log = f"{work}/changes"
    landed = T.StructType([stream.schema[key], *[f for f in stream.schema.fields if f.name != key]])

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        newest = sync.latest_record(batch, key, order).select(*landed.names)
        # A batch that is run again after a failure may lie in a merged part already.
        if not any(first <= batch_id <= last for level, first, last, _ in _parts(session, log) if level):
            newest.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{log}/L0-{batch_id}-{batch_id}")
        tier_log(session, log, landed, key, order)

    run_once(stream, work, "append", land)
    return sync.refresh_merge(target, read_changes(target.sparkSession, log, landed, key, order), key, ownership)


def compact_registry(merged: DataFrame, path: str) -> DataFrame:
    """Write the merged registry as the next base table."""
    merged.write.parquet(path)
    return merged.sparkSession.read.schema(merged.schema).parquet(path)


def stream_activity_dedup(stream: DataFrame, ts: str, key: list[str], work: str) -> DataFrame:
    """Each event once over all feeds, by date, kind, counterpart and deal, inside the watermark."""
    once = stream.withWatermark(ts, ACTIVITY_DELAY).dropDuplicatesWithinWatermark(key)
    run_once(once, work, "append", batch_sink(f"{work}/out"))
    return read_parts(stream.sparkSession, f"{work}/out", once.schema).drop("batch_id")


def windowed_updates(stream: DataFrame, ts: str, delay: str, window: Column, keys: list[Column], aggs: list[Column], work: str) -> DataFrame:
    """Windowed aggregates in update mode: the sink keeps each update, the result is the last one."""
    grouped = stream.withWatermark(ts, delay).groupBy(window.alias("w"), *keys).agg(*aggs)
    flat = grouped.withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w")
    run_once(flat, work, "update", batch_sink(f"{work}/out"))
    names = [c for c in flat.columns if c not in [a for a in flat.columns[len(keys): len(keys) + len(aggs)]]]
    return latest_of(read_parts(stream.sparkSession, f"{work}/out", flat.schema), names)


def stream_cadence_counts(stream: DataFrame, ts: str, work: str, size: str = "7 days") -> DataFrame:
    """Events per kind in tumbling windows; weeks start on Monday."""
    return windowed_updates(stream, ts, ACTIVITY_DELAY, F.window(ts, size, startTime="4 days"), [F.col("kind")], [F.count(F.lit(1)).alias("events")], work)


def stream_engagement(stream: DataFrame, ts: str, work: str, size: str = "14 days", step: str = "1 day") -> DataFrame:
    """The engagement score over a window that moves each day."""
    scored = stream.withColumn("event_class", engagement.event_class()).withColumn("points", engagement.points())
    return windowed_updates(
        scored, ts, ACTIVITY_DELAY, F.window(ts, size, step), [F.col("account")],
        [F.sum("points").alias("score"), F.count(F.lit(1)).alias("events")], work)


def stream_event_time(stream: DataFrame, event_ts: str, work: str) -> tuple[DataFrame, int]:
    """News by the day it happened, not the day it arrived; also how many rows came too late."""
    spark = stream.sparkSession
    grouped = stream.withWatermark(event_ts, SIGNAL_DELAY).groupBy(F.window(event_ts, "1 day").alias("w"), "signal_type").agg(F.count(F.lit(1)).alias("signals"))
    flat = grouped.select(F.col("w.start").alias("event_day"), "signal_type", "signals")
    late = []

    class Late(StreamingQueryListener):
        """Adds up over every batch; the query itself remembers the last hundred only."""

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            late.append((event.progress.runId, event.progress.batchId, sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)))

        def onQueryTerminated(self, event):
            pass

    listener = Late()
    spark.streams.addListener(listener)
    try:
        query = run_once(flat, work, "update", batch_sink(f"{work}/out"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    dropped = sum(n for run, _, n in set(late) if str(run) == str(query.runId))
    return latest_of(read_parts(spark, f"{work}/out", flat.schema), ["event_day", "signal_type"]), dropped


def stream_unseen(stream: DataFrame, reviewed: DataFrame, key: str, work: str) -> DataFrame:
    """Rows not yet reviewed, each once; what an earlier batch handed out does not come back.

    The keys handed out are keyed state, dealt out by key and kept on disk by RocksDB. A batch looks up its own keys there and saves what it adds, so it
    costs the same however many batches went before. Rows without a key are handed out as they come.
    """
    spark = stream.sparkSession
    fresh = stream.join(reviewed.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*stream.schema.names)
    once = fresh.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(fresh.filter(F.col(key).isNull()))
    with rocks_state(spark):
        run_once(once, work, "append", batch_sink(f"{work}/out"))
    return read_parts(spark, f"{work}/out", stream.schema).drop("batch_id", "part")


def stream_inbox(spark: SparkSession, folder: str, work: str) -> DataFrame:
    """Each file dropped into a folder is taken once, whole, with its path; the original stays."""
    schema = T.StructType([T.StructField("value", T.StringType())])
    files = spark.readStream.schema(schema).text(folder, wholetext=True).withColumn("raw_path", F.col("_metadata.file_path"))
    run_once(files, work, "append", batch_sink(f"{work}/out"))
    return read_parts(spark, f"{work}/out", files.schema).drop("batch_id", "part")


def stream_drift(stream: DataFrame, local: DataFrame, baseline: DataFrame, key: str, cols: list[str], work: str) -> DataFrame:
    """Class of each arriving source field against the local and the last synced value."""
    side_l = local.select(key, *[F.col(c).alias(f"l_{c}") for c in cols])
    side_b = baseline.select(key, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = stream.join(side_l, key, "left").join(side_b, key, "left")
    fields = []
    for c in cols:
        mine, theirs, base = F.col(f"l_{c}"), F.col(c), F.col(f"b_{c}")
        kind = F.when(mine.eqNullSafe(theirs), "IN-SYNC").when(mine.eqNullSafe(base), "DRIFT").when(theirs.eqNullSafe(base), "AHEAD").otherwise("CONFLICT")
        fields.append(F.struct(F.lit(c).alias("field"), kind.alias("sync_class")))
    rows = j.select(key, F.explode(F.array(*fields)).alias("f")).select(key, "f.field", "f.sync_class")
    run_once(rows, work, "append", batch_sink(f"{work}/out"))
    return read_parts(stream.sparkSession, f"{work}/out", rows.schema).drop("batch_id", "part")


class DailyCap(StatefulProcessor):
    """How many tasks each rule has raised on a day; the best of a batch fill what the cap leaves. The count goes when the day is past."""

    def __init__(self, caps: Mapping[str, int]):
        self.caps = dict(caps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule, day = key
        used = self.used.get()[0] if self.used.exists() else 0
        # Each task has cut its candidates to the cap, so these are few.
        best = best_first(pd.concat(list(rows))).head(max(self.caps[rule] - used, 0))
        if not self.used.exists():
            self.handle.registerTimer(int(pd.Timestamp(day).value // 1_000_000) + DAY_MS)
        self.used.update((used + len(best),))
        yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def best_first(candidates: pd.DataFrame) -> pd.DataFrame:
    return candidates.sort_values(["score", "record_id"], ascending=[False, True], kind="stable")


def _cut_to_cap(caps: Mapping[str, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            both = best_first(batch if kept is None else pd.concat([kept, batch]))
            kept = both[both.groupby(["rule_id", "day"]).cumcount() < both["rule_id"].map(caps)]
        if kept is not None:
            yield kept

    return cut


def stream_task_caps(stream: DataFrame, caps: Mapping[str, int], work: str) -> DataFrame:
    """Raise tasks under a daily cap that holds across batches; a rule without a cap raises all of them.

    A task cuts its candidates to the cap before anything moves, so a rule with very many costs one task no more than the cap; what is left of a rule and day meets the
    number raised so far, in keyed state on disk. The state lives until event time is past the day, and candidates that come later than that are left
    out. Candidates without a rule or day count as uncapped. `stream` holds rule_id, day, record_id and score.
    """
    spark = stream.sparkSession
    schema = stream.schema
    capped = F.coalesce(F.col("rule_id").isin(*caps) & F.col("day").isNotNull(), F.lit(False)) if caps else F.lit(False)
    few = stream.filter(capped).mapInPandas(_cut_to_cap(caps), schema).withColumn("_ts", F.col("day").cast("timestamp")).withWatermark("_ts", ACTIVITY_DELAY)
    raised = few.groupBy("rule_id", "day").transformWithStateInPandas(DailyCap(caps), schema, "append", "eventTime")
    out = raised.unionByName(stream.filter(~capped))
    with rocks_state(spark):
        run_once(out, work, "append", batch_sink(f"{work}/out"))
    return read_parts(spark, f"{work}/out", schema).drop("batch_id", "part")


EXPIRY_OUT = "item_id long, outcome string"
NONE = -1


def _expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold deadline and first use of one item until they can be told apart.

    A use in time ends the wait, the event-time timer ends it otherwise. A use that arrives before
    its item is held for the longest life an item can have.
    """
    deadline, used = state.get if state.exists else (NONE, NONE)
    if state.hasTimedOut:
        state.remove()
        if deadline != NONE:
            yield pd.DataFrame({"item_id": [int(key[0])], "outcome": ["Expired"]})
        return
    for pdf in batches:
        ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
        logged, uses = pdf["kind"] == "logged", ms[pdf["kind"] == "used"]
        if logged.any():
            deadline = int((ms + pdf["ttl_days"] * DAY_MS)[logged].iloc[-1])
        if len(uses):
            used = int(uses.min()) if used == NONE else min(used, int(uses.min()))
    now = state.getCurrentWatermarkMs()
    outcome = None
    if deadline != NONE and used != NONE and used <= deadline:
        outcome = "Used"
    elif deadline != NONE and deadline <= now:
        outcome = "Expired"
    if outcome:
        if state.exists:
            state.remove()
        yield pd.DataFrame({"item_id": [int(key[0])], "outcome": [outcome]})
    elif deadline != NONE or used != NONE:
        state.update((deadline, used))
        state.setTimeoutTimestamp(max(deadline if deadline != NONE else used + LONGEST_TTL_DAYS * DAY_MS, now + 1))


def stream_expiry(stream: DataFrame, work: str) -> DataFrame:
    """Outcome of perishable items: used in time, or expired once event time passes the deadline.

    The state is two timestamps per item that is still waiting.
    """
    out = stream.withWatermark("ts", "1 day").groupBy("item_id").applyInPandasWithState(
        _expire, EXPIRY_OUT, "deadline long, used long", "append", GroupStateTimeout.EventTimeTimeout)
    run_once(out, work, "append", batch_sink(f"{work}/out"))
    return read_parts(stream.sparkSession, f"{work}/out", out.schema).drop("batch_id", "part")
