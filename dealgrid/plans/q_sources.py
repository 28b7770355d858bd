"""Source and sink queries: data derived from the tables goes to the shared folder and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrid.operators import forecast, sync
from dealgrid.plans.common import converted
from dealgrid.plans.q_sync import FIELDS, drift_sql
from dealgrid.plans.registry import query
from dealgrid.session import BY_TASKS, shared_folder
from dealgrid.sources import readers, sinks

REGISTRY = T.StructType([
    T.StructField("opp_id", T.LongType()), T.StructField("stage", T.StringType()), T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("created", T.DateType()), T.StructField("next_step", T.StringType()),
])
EXPORT_COLUMNS = ["Record ID", "Name", "Created Date", "Opted Out", "Converted", "Balance", "Région"]
EXPORT_MAP = {
    "Record ID": ("crm_id", "id"), "Name": ("name", "string"), "Created Date": ("created", "date"),
    "Opted Out": ("opted_out", "boolean"), "Converted": ("converted", "boolean"), "Balance": ("balance", "money"),
}


@query("read_registry", "select opp_id, stage, amount::double as amount, created::varchar as created, next_step, null::varchar as _bad from opportunities")
def _(t):
    path = shared_folder(t.spark, "registry-csv")
    sinks.write_registry(t.opportunities.select(*REGISTRY.fieldNames()), path, "csv")
    return readers.read_registry(t.spark, path, REGISTRY)


@query("write_registry", "select opp_id, stage, amount::double as amount, created::varchar as created, next_step from opportunities")
def _(t):
    path = shared_folder(t.spark, "registry")
    sinks.write_registry(t.opportunities.select(*REGISTRY.fieldNames()), path)
    return t.spark.read.schema(REGISTRY).parquet(path)


def export_file(t):
    """A report as a CRM exports it: cp1252, US dates, mixed booleans, a footer and rows without an id."""
    path = shared_folder(t.spark, "export")
    lid = F.col("lead_id")
    rows = t.leads.select(
        F.when(lid % 10 == 9, "").otherwise(F.concat(F.lit("00Q"), F.lpad(lid.cast("string"), 12, "0"), F.when(lid % 2 == 0, "QAB").otherwise(""))).alias("Record ID"),
        F.concat(F.lit("Société \x80 "), F.col("name")).alias("Name"),
        F.when(lid % 3 == 0, F.date_format("created", "yyyy-MM-dd")).otherwise(F.date_format("created", "M/d/yyyy")).alias("Created Date"),
        F.when(F.col("direct_opt_out"), "1").otherwise("0").alias("Opted Out"),
        F.when(F.col("status") == "Qualified", "TRUE").otherwise("false").alias("Converted"),
        F.concat(F.lit("$"), F.format_number(lid * 10, 2)).alias("Balance"), F.lit("Île").alias("Région"),
    )
    total = t.leads.agg(F.count(F.lit(1)).cast("string").alias("n")).select(
        F.lit("Grand Totals").alias("Record ID"), F.col("n").alias("Name"), *[F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS[2:]])
    rows.unionByName(total).write.option("header", True).option("encoding", "iso-8859-1").csv(path)
    return path


@query("read_export", """
select '00Q' || lpad(lead_id::varchar, 12, '0') as crm_id, 'Société € ' || name as name, created::varchar as created, direct_opt_out as opted_out, status = 'Qualified' as converted, (lead_id * 10)::double as balance
from leads where lead_id % 10 <> 9""")
def _(t):
    good, _ = readers.read_export(t.spark, export_file(t), EXPORT_COLUMNS, EXPORT_MAP, "Record ID")
    return good


@query("read_export_skipped", """
select case when k = 'f' then 'Grand Totals' end as record_id, count(*) as rows from (
  select 'r' as k from leads where lead_id % 10 = 9 union all select 'f' as k) group by 1""")
def _(t):
    _, skipped = readers.read_export(t.spark, export_file(t), EXPORT_COLUMNS, EXPORT_MAP, "Record ID")
    return skipped.groupBy(F.nullif(F.col("Record ID"), F.lit("")).alias("record_id")).agg(F.count(F.lit(1)).alias("rows"))


@query("unmapped_columns", """
select 'loss_reason' as "column", count(loss_reason) as non_null_rows from opportunities union all select 'paper_process', count(paper_process) from opportunities""")
def _(t):
    mapped = dict.fromkeys([c for c in t.opportunities.columns if c not in ("loss_reason", "paper_process")])
    return readers.unmapped_columns(t.opportunities, mapped)


@query("read_crm_snapshot", "select opp_id, stage, amount::double as amount, close_date::varchar as close_date from opp_cur")
def _(t):
    path = shared_folder(t.spark, "crm-snapshot")
    t.opp_cur.select("opp_id", "stage", "amount", "close_date").write.json(path)
    schema = T.StructType([T.StructField("opp_id", T.LongType()), T.StructField("stage", T.StringType()),
                           T.StructField("amount", T.DecimalType(18, 2)), T.StructField("close_date", T.DateType())])
    return readers.read_crm_snapshot(t.spark, path, schema)


@query("read_activity", """
select day::varchar as day, kind, opp_id::varchar as opp_id, email as counterpart_email, subject as detail,
  case when activity_id % 4 = 0 then null when direction = 'outbound' then 'outbound' else 'inbound' end as direction, feed as source from activity""")
def _(t):
    path = shared_folder(t.spark, "activity-batches")
    sender = F.when(F.col("activity_id") % 4 == 0, None).when(F.col("direction") == "outbound", "You@co.example").otherwise(F.col("email"))
    event = F.struct(
        F.when(F.col("activity_id") % 2 == 0, F.date_format("day", "M/d/yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd")).alias("date"), "kind",
        F.col("opp_id").cast("string").alias("opp_id"), F.col("email").alias("counterpart_email"), sender.alias("sender"), F.col("subject").alias("detail"))
    # A batch holds a hundred neighbouring events of one feed.
    batches = t.activity.groupBy(F.col("feed").alias("source"), F.floor(F.col("activity_id") / 100).alias("_b")).agg(F.collect_list(event).alias("events"))
    batches.select("source", F.array(F.lit("you@co.example")).alias("user_emails"), "events").write.json(path)
    return readers.read_activity(t.spark, path)


@query("read_transcripts", """
select meeting_id::varchar as meeting_id, turn, case role when 'user' then 'José Álvarez-Núñez' when 'assistant' then 'Speaker 1' else 'Recorder' end as speaker, text from turns""")
def _(t):
    path = shared_folder(t.spark, "transcripts")
    speaker = F.when(F.col("role") == "user", "José Álvarez-Núñez").when(F.col("role") == "assistant", "Speaker 1").otherwise("Recorder")
    # One whole transcript per conversation; its turns are bounded by the length of one call.
    line = F.struct("turn", F.concat(speaker, F.lit(": "), F.col("text")).alias("line"))
    whole = t.turns.groupBy("meeting_id").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    texts = whole.select(F.col("meeting_id").cast("string").alias("_id"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("value"))
    # One folder, and in it one file, for each conversation: the file name gives way to the folder's.
    texts.repartition("_id").write.partitionBy("_id").options(**BY_TASKS).option("lineSep", "\n\u0003").text(path)
    found = readers.read_transcripts(t.spark, path)
    return found.select(F.regexp_extract("raw_path", "_id=([^/]+)/", 1).alias("meeting_id"), "turn", "speaker", F.rtrim(F.col("text"), F.lit("\n\u0003")).alias("text"))


def dirty_cells(t):
    created = F.when(F.col("opp_id") % 20 == 1, "soon").when(F.col("opp_id") % 2 == 0, F.date_format("created", "M/d/yyyy")).otherwise(F.col("created").cast("string"))
    shown = F.concat(F.lit("$"), F.col("amount"))
    shown = F.when(F.col("opp_id") % 4 == 3, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    dirty = t.opportunities.select("opp_id", created.alias("created"), shown.alias("amount"), "stage")
    return readers.repair_registry(dirty, {"created": "date", "amount": "money"})


@query("repair_registry", """
select 'created' as "column", count(*) filter (opp_id % 2 = 0) as repaired, count(*) filter (opp_id % 20 = 1) as unreadable from opportunities
union all select 'amount', count(*), 0 from opportunities""")
def _(t):
    return dirty_cells(t)[1]


@query("repaired_rows", """
select opp_id, case when opp_id % 20 <> 1 then created end::varchar as created, case when opp_id % 4 = 3 then -amount else amount end::double as amount, stage from opportunities""")
def _(t):
    return dirty_cells(t)[0]


@query("seed_registry", "select opp_id, stage from opportunities")
def _(t):
    path = shared_folder(t.spark, "seed")
    sinks.seed_registry(t.opportunities.select("opp_id", "stage"), path)
    try:
        sinks.seed_registry(t.opportunities.select("opp_id", "stage"), path)
    except sinks.RegistryNotEmpty:
        return t.spark.read.parquet(path)
    raise AssertionError("a second first load must be refused")


@query("append_forecast_snapshot", """
select cadence, taken_at, track, open_total from (
  select track, coalesce(sum(converted_amount), 0)::decimal(18,2)::double as open_total from o_conv where is_open group by 1)
join (values ('weekly', '2001-07-26'), ('weekly', '2001-08-02'), ('monthly', '2001-08-02')) as c(cadence, taken_at) on true""")
def _(t):
    path = shared_folder(t.spark, "snapshots")
    position = converted(t).filter("is_open").groupBy("track").agg(forecast.total(F.col("converted_amount")).alias("open_total"))
    for cadence, day in (("weekly", "2001-07-26"), ("weekly", "2001-08-02"), ("monthly", "2001-08-02")):
        sinks.append_forecast_snapshot(position, path, cadence, day)
    return t.spark.read.parquet(path).select("cadence", "taken_at", "track", "open_total")


@query("append_sync_log", "with ids as (select opp_id from opp_local union select opp_id from opp_cur union select opp_id from opp_prev),\nv as ("
       + "\nunion all ".join(drift_sql(f, "") for f in FIELDS) + ")\nselect sync_class as outcome, count(*) as rows, 'opportunities' as registry, '2001-08-02 06:00:00' as synced_at from v group by 1")
def _(t):
    path = shared_folder(t.spark, "sync-log")
    sinks.append_sync_log(sync.verify_sync(t.opp_local, t.opp_cur, t.opp_prev, "opp_id", FIELDS), path, "opportunities", "2001-08-02 06:00:00")
    return t.spark.read.parquet(path)


WHOLE = """
select 'doc=' || coalesce(doc_id::varchar, '__HIVE_DEFAULT_PARTITION__') as folder, sha256(coalesce(text, '') || chr(10)) as sha256, octet_length(encode(coalesce(text, '') || chr(10))) as bytes from documents
"""


@query("content_manifest", WHOLE)
@query("content_manifest_whole", WHOLE)
def _(t):
    # Every document, a null text as an empty one.
    path = shared_folder(t.spark, "all owned (files)+")
    owned = t.documents.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    sinks.write_files(owned, "doc", "text", path)
    found = readers.content_manifest(t.spark, path, "*.txt")
    return found.select(F.regexp_extract("rel", r"(?:^|/)(doc=[^/]+?)(?:\.txt|/[^/]+)$", 1).alias("folder"), "sha256", "bytes")
