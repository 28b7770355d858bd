"""Streaming queries: the given files as streams, each next to its batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.plans.q_sync import FIELDS, drift_sql
from dealgrid.plans.q_tasks import CAPS
from dealgrid.plans.registry import Tables, query
from dealgrid.session import shared_folder
from dealgrid.streaming import jobs


class StreamTables(Tables):
    """The same views with one given table read as a file stream."""

    def __init__(self, spark: SparkSession, sf_dir: str, streamed: str):
        super().__init__(spark, sf_dir)
        self.streamed = streamed

    def __getattr__(self, name: str) -> DataFrame:
        if name == self.__dict__.get("streamed"):
            path = f"{self.sf_dir}/{name}.parquet"
            schema = self.spark.read.parquet(path).schema
            # A table is one file or a folder of them.
            if jobs.is_folder(self.spark, path):
                return jobs.file_stream(self.spark, path, schema, "*")
            return jobs.file_stream(self.spark, self.sf_dir, schema, f"{name}.parquet")
        return super().__getattr__(name)


def streamed(t: Tables, table: str) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir, table)


@query("stream_refresh", """
select coalesce(l.opp_id, s.opp_id) as opp_id, case when s.opp_id is not null then s.stage else l.stage end as stage,
  (case when s.opp_id is not null then s.amount else l.amount end)::double as amount, l.notes from opp_local l full join opp_cur s on l.opp_id = s.opp_id""")
def _(t):
    changes = streamed(t, "orders").sql("select opp_id, stage, amount, close_date as modified from opp_cur")
    target = t.opp_local.select("opp_id", "stage", "amount", "notes")
    return jobs.stream_refresh(changes, target, "opp_id", ["modified"], {"stage": "crm", "amount": "crm"}, shared_folder(t.spark, "stream-refresh"))


@query("stream_activity_dedup", "select distinct day::varchar as day, kind, account, person from raw_activity")
def _(t):
    events = streamed(t, "events").sql("select ts, day, kind, account, person from raw_activity")
    once = jobs.stream_activity_dedup(events, "ts", ["day", "kind", "account", "person"], shared_folder(t.spark, "stream-dedup"))
    return once.select("day", "kind", "account", "person")


@query("stream_cadence_counts", """
select kind, count(*) as events, date_trunc('week', ts)::timestamp::varchar as window_start, (date_trunc('week', ts)::timestamp + interval '7' day)::varchar as window_end from raw_activity group by 1, 3, 4""")
def _(t):
    events = streamed(t, "events").sql("select ts, kind from raw_activity")
    return jobs.stream_cadence_counts(events, "ts", shared_folder(t.spark, "stream-cadence"))


@query("stream_engagement", """
select account, sum(case when kind = 'meeting' then 5 when subject like 'Automatic reply%' then 0 when direction = 'inbound' then 3 when direction = 'outbound' then 1 end)::bigint as score, count(*) as events,
  (day - i::int)::timestamp::varchar as window_start, (day - i::int + 14)::timestamp::varchar as window_end from raw_activity join range(14) r(i) on true group by account, day - i::int""")
def _(t):
    events = streamed(t, "events").sql("select ts, account, kind, direction, subject from raw_activity")
    return jobs.stream_engagement(events, "ts", shared_folder(t.spark, "stream-engagement"))


@query("stream_event_time", "select event_date::timestamp::varchar as event_day, signal_type, count(*) as signals from signals group by 1, 2")
def _(t):
    news = streamed(t, "documents").sql("select cast(event_date as timestamp) as event_ts, signal_type from signals")
    counts, _ = jobs.stream_event_time(news, "event_ts", shared_folder(t.spark, "stream-event-time"))
    return counts


@query("stream_unseen", "select signal_id, signal_type, relevance from signals where content_reviewed = 'no'")
def _(t):
    news = streamed(t, "documents").sql("select signal_id, signal_type, relevance from signals")
    reviewed = t.signals.filter("content_reviewed = 'yes'").select("signal_id")
    return jobs.stream_unseen(news, reviewed, "signal_id", shared_folder(t.spark, "stream-unseen"))


@query("stream_inbox", "select replace(text, chr(10), ' ') as line, count(*) as n from turns group by 1")
def _(t):
    folder = shared_folder(t.spark, "inbox")
    t.turns.select(F.translate("text", "\n", " ").alias("value")).write.text(folder)
    files = jobs.stream_inbox(t.spark, folder, shared_folder(t.spark, "stream-inbox"))
    lines = files.select(F.explode(F.split("value", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("stream_drift", "with ids as (select opp_id from opp_cur)\nselect opp_id, field, sync_class from (" + "\nunion all ".join(drift_sql(f, "") for f in FIELDS) + ")")
def _(t):
    arriving = streamed(t, "orders").opp_cur.select("opp_id", *FIELDS)
    return jobs.stream_drift(arriving, t.opp_local, t.opp_prev, "opp_id", list(FIELDS), shared_folder(t.spark, "stream-drift"))


@query("stream_task_caps", """
select rule_id, day::varchar as day, record_id, score from (
  select event_type as rule_id, day, activity_id as record_id, value as score, row_number() over (partition by event_type, day order by value desc, activity_id) as rank from raw_activity)
where rank <= case rule_id when 'click' then 5 when 'view' then 10 when 'purchase' then 3 when 'signup' then 20 else 1000000 end""")
def _(t):
    raised = streamed(t, "events").sql("select event_type as rule_id, day, activity_id as record_id, value as score from raw_activity")
    return jobs.stream_task_caps(raised, CAPS, shared_folder(t.spark, "stream-caps"))


ITEMS = """
select content_id as item_id, cast(logged as timestamp) as logged, case perishability when 'Hours' then 1 when 'Days' then 7 when 'Weeks' then 28 end as ttl_days,
  case when status = 'Published' then cast(logged + cast(content_id % 10 as int) as timestamp) end as used from content_opps"""


@query("stream_expiry", f"""
with i as ({ITEMS}), m as (select greatest(max(logged), max(used)) - interval '1' day as mark from i where ttl_days is not null)
select item_id, case when used <= logged + to_days(ttl_days) then 'Used' else 'Expired' end as outcome from i, m
where ttl_days is not null and (used <= logged + to_days(ttl_days) or logged + to_days(ttl_days) <= mark)""")
def _(t):
    items = streamed(t, "documents").sql(ITEMS).filter("ttl_days is not null")
    logged = F.struct(F.lit("logged").alias("kind"), F.col("logged").alias("ts"), F.col("ttl_days").cast("long").alias("ttl_days"))
    used = F.when(F.col("used").isNotNull(), F.struct(F.lit("used").alias("kind"), F.col("used").alias("ts"), F.lit(0).cast("long").alias("ttl_days")))
    rows = items.select("item_id", F.explode(F.array_compact(F.array(logged, used))).alias("e")).select("item_id", "e.*")
    return jobs.stream_expiry(rows, shared_folder(t.spark, "stream-expiry"))
