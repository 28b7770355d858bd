"""Streams over several batches and restarts, next to what one batch would give."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrid.streaming import jobs


def drop(spark, rows, schema, folder):
    """One more file in the folder; files are taken in order of their time stamps."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def stream(spark, folder, schema):
    return jobs.file_stream(spark, folder, T._parse_datatype_string(schema) if isinstance(schema, str) else schema, "*.parquet", files_per_batch=1)


def ts(day, hour=0):
    return dt.datetime(2026, 7, day, hour)


def test_dedup_holds_over_batches(spark, tmp_path):
    cols = "ts timestamp, kind string, email string, opp_id long"
    folder = str(tmp_path / "in")
    drop(spark, [(ts(1), "meeting", "x", 1), (ts(1, 3), "meeting", "x", 1)], cols, folder)
    drop(spark, [(ts(1, 5), "meeting", "x", 1), (ts(2), "email", "x", 1)], cols, folder)
    out = jobs.stream_activity_dedup(stream(spark, folder, cols), "ts", ["kind", "email", "opp_id"], str(tmp_path / "w"))
    assert {(r.kind, r.email) for r in out.collect()} == {("meeting", "x"), ("email", "x")} and out.count() == 2


def test_task_caps_hold_over_batches_and_restarts(spark, tmp_path):
    cols = "rule_id string, day date, record_id long, score double"
    folder, work = str(tmp_path / "in"), str(tmp_path / "w")
    day = dt.date(2026, 7, 1)
    drop(spark, [("a", day, i, float(i)) for i in range(2)], cols, folder)
    drop(spark, [("a", day, i, float(i)) for i in range(10, 20)] + [("b", day, 1, 1.0)], cols, folder)
    first = jobs.stream_task_caps(stream(spark, folder, cols), {"a": 3, "b": 3}, work)
    assert sorted((r.rule_id, r.record_id) for r in first.collect()) == [("a", 0), ("a", 1), ("a", 19), ("b", 1)]
    drop(spark, [("a", day, 99, 9.0), ("b", day, 2, 1.0), ("a", day + dt.timedelta(1), 5, 1.0)], cols, folder)
    again = jobs.stream_task_caps(stream(spark, folder, cols), {"a": 3, "b": 3}, work)
    assert sorted((r.rule_id, r.record_id) for r in again.collect()) == [("a", 0), ("a", 1), ("a", 5), ("a", 19), ("b", 1), ("b", 2)]


def test_task_caps_by_day(spark, tmp_path):
    """Uncapped and nameless rules pass, a day's count ends with the day, and what comes later than that is left out."""
    cols = "rule_id string, day date, record_id long, score double"
    folder, work = str(tmp_path / "in"), str(tmp_path / "w")
    day = lambda n: dt.date(2026, 7, n)
    drop(spark, [("a", day(1), i, 1.0) for i in range(500)] + [("free", day(1), i, 1.0) for i in range(7)] + [(None, day(1), 1, 1.0), ("a", None, 2, 1.0)], cols, folder)
    drop(spark, [("a", day(9), 1, 1.0)], cols, folder)
    drop(spark, [("a", day(9), 2, 1.0), ("a", day(9), 3, 5.0)], cols, folder)
    drop(spark, [("a", day(1), 999, 9.0), ("a", day(9), 4, 9.0)], cols, folder)
    got = jobs.stream_task_caps(stream(spark, folder, cols), {"a": 2}, work).collect()
    assert sorted((r.day.day, r.record_id) for r in got if r.rule_id == "a" and r.day) == [(1, 0), (1, 1), (9, 1), (9, 3)]
    assert sum(r.rule_id == "free" for r in got) == 7 and sum(r.rule_id is None or r.day is None for r in got) == 2


def test_change_log_stays_short(spark, tmp_path):
    """However many batches there are, few parts are read, and the newest change wins in every order of levels."""
    cols = "id long, stage string, modified date"
    folder, work = str(tmp_path / "in"), str(tmp_path / "w")
    target = spark.createDataFrame([(k, "old") for k in range(5)], "id long, stage string")
    want, n = {k: "old" for k in range(5)}, 0
    for k in range(3 * jobs.LEVEL_PARTS + 2):
        rows = [(k % 7, f"s{k}", dt.date(2026, 1, 1) + dt.timedelta(k)), (6, "late", dt.date(2025, 1, 1))]
        drop(spark, rows, cols, folder)
        want[k % 7] = f"s{k}"
    out = jobs.stream_refresh(stream(spark, folder, cols), target, "id", ["modified"], {"stage": "crm"}, work)
    assert {r.id: r.stage for r in out.collect()} == want
    parts = jobs._parts(spark, f"{work}/changes")
    assert [p[0] for p in parts] == [0, 0, 1, 1, 1]


def test_windows_keep_the_last_update(spark, tmp_path):
    cols = "ts timestamp, kind string"
    folder = str(tmp_path / "in")
    drop(spark, [(ts(6), "email"), (ts(7), "email")], cols, folder)
    drop(spark, [(ts(8), "email"), (ts(14), "email")], cols, folder)
    out = jobs.stream_cadence_counts(stream(spark, folder, cols), "ts", str(tmp_path / "w"))
    assert {(r.window_start.day, r.events) for r in out.collect()} == {(6, 3), (13, 1)}


def test_late_news_counts_by_event_day_and_too_late_is_counted_apart(spark, tmp_path):
    cols = "event_ts timestamp, signal_type string"
    folder = str(tmp_path / "in")
    drop(spark, [(ts(1), "funding"), (ts(25), "funding")], cols, folder)
    drop(spark, [(ts(26), "funding")], cols, folder)
    drop(spark, [(ts(15), "funding"), (ts(2), "funding")], cols, folder)
    out, dropped = jobs.stream_event_time(stream(spark, folder, cols), "event_ts", str(tmp_path / "w"))
    assert {(r.event_day.day, r.signals) for r in out.collect()} == {(1, 1), (25, 1), (15, 1), (26, 1)} and dropped == 1


def test_unseen_rows_come_once(spark, tmp_path):
    cols = "signal_id long, relevance string"
    folder, work = str(tmp_path / "in"), str(tmp_path / "w")
    reviewed = spark.createDataFrame([(2,)], "signal_id long")
    drop(spark, [(1, "High"), (2, "Low"), (1, "High")], cols, folder)
    drop(spark, [(1, "High"), (3, "Low")], cols, folder)
    assert sorted(r.signal_id for r in jobs.stream_unseen(stream(spark, folder, cols), reviewed, "signal_id", work).collect()) == [1, 3]
    drop(spark, [(3, "Low"), (4, "Low")], cols, folder)
    assert sorted(r.signal_id for r in jobs.stream_unseen(stream(spark, folder, cols), reviewed, "signal_id", work).collect()) == [1, 3, 4]


def test_inbox_takes_each_file_once_and_keeps_it(spark, tmp_path):
    box, work = tmp_path / "box", str(tmp_path / "w")
    box.mkdir()
    (box / "a.txt").write_text("one\ntwo")
    jobs.stream_inbox(spark, str(box), work)
    (box / "b.txt").write_text("three")
    got = {r.value for r in jobs.stream_inbox(spark, str(box), work).collect()}
    assert got == {"one\ntwo", "three"} and (box / "a.txt").exists()


def test_refresh_lands_changes_and_reads_the_newest(spark, tmp_path):
    cols = "id long, stage string, modified date"
    folder, work = str(tmp_path / "in"), str(tmp_path / "w")
    target = spark.createDataFrame([(1, "Qualify", "mine"), (2, "Qualify", "mine")], "id long, stage string, notes string")
    drop(spark, [(1, "Proposal", dt.date(2026, 7, 2)), (3, "Discovery", dt.date(2026, 7, 2))], cols, folder)
    drop(spark, [(1, "Validate", dt.date(2026, 7, 1)), (3, "Proposal", dt.date(2026, 7, 3))], cols, folder)
    out = jobs.stream_refresh(stream(spark, folder, cols), target, "id", ["modified"], {"stage": "crm"}, work)
    want = {(1, "Proposal", "mine"), (2, "Qualify", "mine"), (3, "Proposal", None)}
    assert {tuple(r) for r in out.collect()} == want
    base = jobs.compact_registry(out, str(tmp_path / "base"))
    assert {tuple(r) for r in base.collect()} == want


def test_expiry_by_event_time(spark, tmp_path):
    cols = "item_id long, kind string, ts timestamp, ttl_days long"
    folder, work = str(tmp_path / "in"), str(tmp_path / "w")
    drop(spark, [(1, "logged", ts(1), 1), (2, "logged", ts(1), 7), (3, "logged", ts(1), 60), (4, "used", ts(2), 0)], cols, folder)
    drop(spark, [(2, "used", ts(5), 0), (4, "logged", ts(1), 7)], cols, folder)
    drop(spark, [(9, "logged", ts(20), 60)], cols, folder)
    drop(spark, [(9, "note", ts(21), 0)], cols, folder)
    got = {(r.item_id, r.outcome) for r in jobs.stream_expiry(stream(spark, folder, cols), work).collect()}
    assert got == {(1, "Expired"), (2, "Used"), (4, "Used")}


def test_drift_against_static_sides(spark, tmp_path):
    cols = "id long, f string"
    folder = str(tmp_path / "in")
    drop(spark, [(1, "a"), (2, "b")], cols, folder)
    drop(spark, [(3, "a"), (4, "c")], cols, folder)
    local = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], cols)
    base = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], cols)
    out = jobs.stream_drift(stream(spark, folder, cols), local, base, "id", ["f"], str(tmp_path / "w"))
    assert {r.id: r.sync_class for r in out.collect()} == {1: "IN-SYNC", 2: "DRIFT", 3: "AHEAD", 4: "CONFLICT"}


def test_streamed_score_equals_the_batch_score(spark, tmp_path):
    from dealgrid.operators import engagement

    cols = "ts timestamp, account long, opp_id long, kind string, direction string, subject string, day date"
    rows = [(ts(d), 1, 1, "email", "inbound" if d % 2 else "outbound", "hi", dt.date(2026, 7, d)) for d in range(1, 15)]
    folder = str(tmp_path / "in")
    drop(spark, rows[:7], cols, folder)
    drop(spark, rows[7:], cols, folder)
    out = jobs.stream_engagement(stream(spark, folder, cols), "ts", str(tmp_path / "w"))
    batch = engagement.engagement_score(spark.createDataFrame(rows, cols), "2026-07-15").first().score
    assert out.filter(F.col("window_end") == F.lit("2026-07-15").cast("timestamp")).first().score == batch


def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path):
    """The same rows come from a table in one file and from one in several."""
    from dealgrid.plans.registry import QUERIES
    import dealgrid.plans.catalog  # noqa: F401

    rows = [(i, f"text {i}", "en", "src1", 6) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir()
    docs.toPandas().to_parquet(one / "documents.parquet")
    docs.repartition(3).write.parquet(str(many / "documents.parquet"))
    for name in ("stream_event_time", "stream_unseen", "stream_expiry"):
        got = [sorted(map(tuple, QUERIES[name](spark, str(folder)).collect())) for folder in (one, many)]
        assert got[0] and got[0] == got[1], name
