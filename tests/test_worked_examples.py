"""Worked numbers, truth tables, refusals and sample floors on small hand-made frames."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from dealgrid.functions import columns as fn
from dealgrid.operators import competitors, deals, demand, engagement, forecast, fx, leads, market, meetings, partners, quotes, renewals, sync, tasks
from dealgrid.sources import readers, sinks

DAY = dt.date(2026, 8, 1)
RATES = "currency string, rate decimal(18,8), source string, effective_from date"


def rates(spark, *rows):
    return spark.createDataFrame([(c, D(r), s, dt.date.fromisoformat(d)) for c, r, s, d in rows], RATES)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalar_functions(spark):
    row = one(
        spark, fn.norm_company(F.lit("Acme, Inc.")).alias("a"), fn.norm_company(F.lit("The ACME Corporation")).alias("b"),
        fn.norm_domain(F.lit("https://WWW.acme.com:8080/x?y#z")).alias("c"), fn.norm_domain(F.lit("Jane@Acme.com")).alias("d"),
        fn.norm_domain(F.lit("")).alias("e"), fn.parse_mixed_date(F.lit("3/7/2026")).alias("f"), fn.parse_mixed_date(F.lit("soon")).alias("g"),
        fn.parse_mixed_bool(F.lit("TRUE")).alias("h"), fn.parse_mixed_bool(F.lit("maybe")).alias("i"), fn.parse_money(F.lit("$1,200.50")).alias("j"),
        fn.format_local_id("OPP", 4, F.lit(31)).alias("k"), fn.format_local_id("OPP", 4, F.lit(123456)).alias("l"),
        fn.split_list(F.lit(" Distributor ; Reseller ;")).alias("m"), fn.split_list(F.lit(" ")).alias("n"),
        fn.list_permits(fn.split_list(F.lit("")), F.lit("x")).alias("o"), fn.norm_record_id(F.lit("001000000000001QAB")).alias("p"),
        fn.invert_rate(F.lit("0.91")).alias("q"), fn.fiscal_quarter(F.lit(dt.date(2026, 1, 15)), 2).alias("r"), fn.invert_rate(F.lit("0")).alias("s"),
    )
    assert (row.a, row.b, row.c, row.d, row.e) == ("acme", "acme", "acme.com", "acme.com", None)
    assert (row.f, row.g, row.h, row.i, row.j) == (dt.date(2026, 3, 7), None, True, None, D("1200.50"))
    assert (row.k, row.l, row.m, row.n, row.o) == ("OPP-0031", "OPP-123456", ["Distributor", "Reseller"], None, True)
    assert row.p == "001000000000001" and row.q == D("1.09890110") and row.s is None
    assert tuple(row.r) == (dt.date(2025, 11, 1), dt.date(2026, 1, 31))


def book(spark):
    return spark.createDataFrame(
        [(1, D("80000"), "EUR", "Negotiate", DAY), (2, D("120000"), "USD", "Negotiate", DAY), (3, D("10"), "CHF", "Negotiate", DAY)],
        "opp_id int, amount decimal(18,2), currency string, stage string, close_date date")


@pytest.mark.parametrize("bound", [100, 0])
def test_mixed_book_converts_and_lists_what_it_cannot(spark, bound):
    table = rates(spark, ("EUR", "1.09890110", "crm", "2026-01-01"))
    out = fx.fx_convert(book(spark), table, "2026-08-01", max_rate_rows=bound)
    got = {r.opp_id: r.converted_amount for r in out.collect()}
    assert got == {1: D("87912.09"), 2: D("120000.00"), 3: None}
    assert out.agg(F.sum("converted_amount")).first()[0] == D("207912.09")
    assert [(r.opp_id, r.reason) for r in fx.unconverted_report(out, table, "opp_id").collect()] == [(3, "no rate for currency")]


@pytest.mark.parametrize("bound", [100, 0])
def test_closed_rows_stay_and_open_rows_move_with_a_new_rate(spark, bound):
    rows = spark.createDataFrame(
        [(1, D("100"), "EUR", "Closed Won", dt.date(2026, 2, 1)), (2, D("100"), "EUR", "Proposal", dt.date(2026, 2, 1))],
        "opp_id int, amount decimal(18,2), currency string, stage string, close_date date")
    old = rates(spark, ("EUR", "1.10", "crm", "2026-01-01"))
    new = old.unionByName(rates(spark, ("EUR", "1.30", "crm", "2026-06-01")))
    before = {r.opp_id: r.converted_amount for r in fx.fx_convert(rows, old, "2026-08-01", max_rate_rows=bound).collect()}
    after = {r.opp_id: r.converted_amount for r in fx.fx_convert(rows, new, "2026-08-01", max_rate_rows=bound).collect()}
    assert before[1] == after[1] == D("110.00") and (before[2], after[2]) == (D("110.00"), D("130.00"))


def test_tier_price_estimate_and_floor(spark):
    tiers = spark.createDataFrame([("S", 1, D("100")), ("S", 500, D("88")), ("S", 2000, D("74"))], "sku string, min_qty long, price decimal(18,2)")
    row = quotes.estimate_value(spark.createDataFrame([("S", 500)], "sku string, qty long"), tiers).first()
    assert (row.estimate, row.at_list, row.next_qty, row.next_price) == (D("44000"), D("50000"), 2000, D("74"))
    lines = spark.createDataFrame([(1, "S", 500, D("0.1"), "Volume"), (2, "S", 500, D("0.1"), None), (3, "X", 5, D("0"), None)],
                                  "line int, sku string, qty long, discount decimal(5,4), discount_reason string")
    listed = "sku string, floor_price decimal(18,2), increment long, min_qty_sold long, status string, expires date"
    for floor, fails in ((D("79"), False), (D("80"), True)):
        prices = spark.createDataFrame([("S", floor, 1, 1, "Active", dt.date(2030, 1, 1))], listed)
        got = {r.line: r for r in quotes.quote_guardrails(lines, prices, tiers, "2026-08-01").collect()}
        assert got[1].net_price == D("79.20") and ("under floor" in got[1].problems) is fails
        assert "discount without reason" in got[2].problems and got[3].problems == ["not on the list"]


def test_same_tier_is_the_only_conflict(spark):
    day = dt.date(2026, 7, 1)
    held = [("c1", "Distributor", 1), ("c1", "Reseller", 2), ("c2", "Distributor", 1), ("c2", "Reseller", 1), ("c3", "Reseller", 2), ("c3", "Reseller", 4), ("c3", "Reseller", 5)]
    regs = spark.createDataFrame([(*h, day, 90) for h in held] + [("c3", "Distributor", p, dt.date(2025, 1, 1), 30) for p in (3, 6, 7)],
                                 "customer_key string, role string, partner_id long, approved date, protection_days int")
    subs = spark.createDataFrame(
        [(1, 2, "c1", "Reseller"), (2, 1, "c2", "Reseller"), (3, 3, "c3", "Reseller"), (4, 3, "c3", "Distributor"), (5, 5, "c3", "Reseller")],
        "submission_id int, partner_id long, customer_key string, role string")
    as_of = "2026-08-01"
    same = sorted((r.submission_id, r.severity, r.detail, r.others) for r in partners.conflict_same_tier(subs, regs, as_of).collect())
    assert same == [(3, "BLOCK", "c3/Reseller", 3), (5, "BLOCK", "c3/Reseller", 2)]
    behind = partners.claim_holders(regs, as_of)
    assert {r.partner_id for r in behind.filter("holder_class = 'c3/Reseller'").collect()} == {2, 4, 5}
    assert {r.partner_id for r in behind.filter("holder_class = 'c3/lapsed'").collect()} == {3, 6, 7}
    notes = {(r.submission_id, r.finding, r.others) for r in partners.conflict_teaming(subs, regs, as_of).collect()}
    assert notes == {(1, "teaming", 1), (1, "already holds this tier", None), (2, "already holds this tier", None), (4, "teaming", 3), (5, "already holds this tier", None)}
    assert {(r.submission_id, r.detail, r.others) for r in partners.conflict_expired(subs, regs, as_of).collect()} == {(3, "c3/lapsed", 2), (4, "c3/lapsed", 2), (5, "c3/lapsed", 3)}


def test_credit_goes_by_registration_then_live_then_lapsed(spark):
    d = lambda m, n=1: dt.date(2026, m, n)
    regs = spark.createDataFrame(
        [("r1", 1, "Reseller", 11, d(1), d(3), None), ("r2", 1, "Reseller", 12, d(2), d(6), None), ("r3", 1, "Reseller", 10, d(2, 5), d(4), None),
         ("r4", 1, "Distributor", 20, d(1), d(2), None), ("r5", 2, "Distributor", 21, d(5), d(9), 6), ("r6", 9, "Reseller", 30, d(1), d(2), None)],
        "reg_id string, customer long, role string, partner_id long, approved date, expires date, opportunity_id long")
    opps = spark.createDataFrame(
        [(1, 1, 12, d(2, 10), None), (2, 1, 12, d(3, 2), None), (3, 1, 12, d(8), None), (4, 1, 12, d(2, 10), "r6"), (5, 7, 12, d(2), "gone"), (6, 2, 12, d(1), None), (7, 1, None, d(2), None)],
        "opp_id long, account long, partner_id long, created date, deal_registration_id string")
    got = {(r.opp_id, r.tier): (r.credited_partner, r.basis) for r in partners.tier_attribution(opps, regs).collect()}
    assert got == {
        (1, "Reseller"): (11, "live claim"), (1, "Distributor"): (20, "lapsed claim, note"), (2, "Reseller"): (12, "live claim"), (2, "Distributor"): (20, "lapsed claim, note"),
        (3, "Reseller"): (12, "lapsed claim, note"), (3, "Distributor"): (20, "lapsed claim, note"), (4, "Reseller"): (30, "registration"), (4, "Distributor"): (20, "lapsed claim, note"),
        (5, "unknown"): (12, "deal partner"), (6, "Distributor"): (21, "registration")}


def test_registration_linked_on_one_side_counts_as_converted(spark):
    opps = spark.createDataFrame([(1, 5, 9, D("10"), "r2")], "opp_id long, partner_id long, account long, amount decimal(18,2), deal_registration_id string")
    regs = spark.createDataFrame([("r1", 5, 9, 1), ("r2", 5, 9, None), ("r3", 5, 9, None)], "reg_id string, partner_id long, customer long, opportunity_id long")
    assert {(r.kind, r.ref) for r in partners.partner_deals(opps, regs).collect()} == {("deal", "1"), ("registration", "r3")}


def test_identity_by_domain_name_and_near_name(spark):
    left = spark.createDataFrame([(1, "Acme, Inc.", "www.acme.com"), (2, "Globex Corp", None), (3, "Initech", None), (4, "Umbrela", None)], "id long, name string, domain string")
    right = spark.createDataFrame([(10, "Acme Corporation", "acme.com"), (11, "The Globex Company", "globex.com"), (12, "Umbrella", None)], "id long, name string, domain string")
    got = {r.left_id: (r.right_id, r.basis) for r in market.resolve_account(left, right).collect()}
    assert got == {1: (10, "domain"), 2: (11, "name"), 4: (12, "near name, review")}


def test_drift_classes_and_null_equality(spark):
    cols = "id int, f string"
    local = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, None), (6, "x")], cols)
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None), (7, "n")], cols)
    base = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, None), (6, "x")], cols)
    got = {r.id: r.sync_class for r in sync.verify_sync(local, source, base, "id", ["f"]).collect()}
    assert got == {1: "IN-SYNC", 2: "DRIFT", 3: "AHEAD", 4: "CONFLICT", 5: "IN-SYNC", 6: "DRIFT", 7: "DRIFT"}


def test_reconcile_covers_every_action(spark):
    h = "k string, hash string"
    new = spark.createDataFrame([("add", "1"), ("same", "1"), ("settled", "2"), ("upd", "2"), ("mrg", "2"), ("keep", "2"), ("nobase", "2"), ("meta", "2")], h)
    cur = spark.createDataFrame([("same", "1"), ("settled", "9"), ("upd", "1"), ("mrg", "9"), ("keep", "9"), ("nobase", "9"), ("meta", "9"), ("gone", "1")], h)
    base = spark.createDataFrame([("settled", "2"), ("upd", "1"), ("mrg", "1"), ("keep", "1"), ("meta", "1")], h)
    disk = spark.createDataFrame([("settled", "9")], h)
    out = sync.reconcile_three_way(new, cur, base, disk, "k", mergeable=F.col("k") == "mrg", metadata=F.col("k") == "meta")
    assert {r.k: r.action for r in out.collect()} == {
        "add": "ADD", "same": "SAME", "settled": "SAME", "upd": "UPDATE", "mrg": "MERGE", "keep": "KEEP", "nobase": "KEEP", "meta": "UPDATE", "gone": "GONE"}


def test_schema_merge_keeps_choices_and_extras(spark):
    l = "registry string, column_no long, column_name string, column_type string, enum_values string, owner string, verify string"
    local = spark.createDataFrame([("r", 1, "a", "enum", "x;mine", "local", "yes"), ("r", 2, "b", "string", None, "local", None), ("r", 3, "own", "string", None, None, None), ("r", 4, "c", "string", None, "local", None)], l)
    new = spark.createDataFrame([("r", 1, "a", "enum", "x;y", "crm", "no", False), ("r", 2, "b", "date", None, "crm", None, True), ("r", 4, "c", "string", None, None, None, False), ("r", 5, "d", "date", None, None, None, False)],
                                l + ", owner_corrected boolean")
    got = {r.column_name: r for r in sync.schema_merge(local, new).collect()}
    assert got["a"].enum_values == "x;y;mine" and got["a"].owner == "local" and got["a"].verify == "yes"
    assert got["b"].column_type == "date" and got["b"].owner == "crm" and "corrected owner" in got["b"].notes
    assert got["own"].at_end and got["c"].owner is None and "owner lost" in got["c"].notes and got["d"].notes == ["new column"]


def acts(spark, rows):
    return spark.createDataFrame(
        [(i, o, e, k, d, s, dt.date.fromisoformat(day)) for i, (o, e, k, d, s, day) in enumerate(rows)],
        "activity_id long, opp_id long, email string, kind string, direction string, subject string, day date")


def test_unknown_direction_is_not_silence(spark):
    a = acts(spark, [(1, "p", "email", None, "hi", "2026-07-30"), (2, "q", "email", "outbound", "hi", "2026-07-30"),
                     (3, "r", "email", "inbound", "Re: hi", "2026-07-30"), (4, "s", "email", "inbound", "Automatic reply: out", "2026-07-30")])
    replied = {r.opp_id: r.replied for r in deals.reply_evidence(a).collect()}
    assert replied == {1: None, 2: False, 3: True, 4: False}
    opps = spark.createDataFrame([(i, "Proposal", True) for i in range(1, 6)], "opp_id long, stage string, is_open boolean")
    roles = spark.createDataFrame([], "opp_id long, email string")
    t = {r.opp_id: (r.state, r.flags) for r in deals.threading_flags(deals.contacts_build(roles, a), deals.people_fold(a), opps).collect()}
    assert t == {1: ("unknown", []), 2: ("known", ["no-reply-ever"]), 3: ("known", ["single-threaded"]),
                 4: ("known", ["auto-reply-only"]), 5: ("no contacts loaded", [])}


def test_outbound_alone_never_heats(spark):
    a = acts(spark, [(1, "p", "email", "outbound", "hi", f"2026-07-{d}") for d in range(26, 31)] + [(2, "p", "meeting", "both", "call", "2026-07-30")])
    got = {r.opp_id: r.trend for r in engagement.engagement_trend(a, "2026-08-01").collect()}
    assert got == {1: "Cooling", 2: "Heating"}


def test_sample_floors(spark):
    df = spark.createDataFrame([(11, 17), (2, 3)], "won int, decided int")
    rows = df.select(fn.guarded_rate(F.col("won"), F.col("decided")).alias("r"), fn.sample_note(F.col("won"), F.col("decided")).alias("n")).collect()
    assert round(rows[0].r, 3) == 0.647 and rows[0].n is None and rows[1].r is None and rows[1].n == "2 of 3"


def test_follow_up_is_diagnosed(spark):
    funnel = spark.createDataFrame([(1, 200, 9, 190, 3)], "group_id int, leads long, leads_worked long, leads_contactable long, opportunities long")
    assert demand.campaign_diagnosis(funnel).first().diagnosis == "follow-up"


def test_blank_notice_gives_no_deadline(spark):
    r = spark.createDataFrame([(1, DAY, 120, None), (2, DAY, 120, 60)], "renewal_id int, contract_end date, lead_days int, notice_days int")
    got = {x.renewal_id: x.notice_deadline for x in renewals.renewal_deadlines(r, "2026-01-01").collect()}
    assert got == {1: None, 2: dt.date(2026, 6, 2)}


def test_coverage_moves_when_one_contract_closes(spark):
    cols = "renewal_id int, status string, contract_end date, converted_current_value decimal(18,2)"
    cur = spark.createDataFrame([(1, "Renewed", DAY, D("20")), (2, "Renewed", DAY, D("30")), (3, "Active", DAY, D("50"))], cols)
    prior = spark.createDataFrame([(1, "Renewed"), (2, "Active"), (3, "Active")], "renewal_id int, status string")
    assert [(r.renewal_id, r.coverage_change) for r in renewals.renewal_movement(cur, prior, "2026-07-01", "2026-09-30").collect()] == [(2, 0.3)]


def test_snapshots_compare_inside_one_cadence(spark):
    s = spark.createDataFrame([("weekly", dt.date(2026, 7, 1), D("1")), ("monthly", dt.date(2026, 7, 2), D("9")), ("weekly", dt.date(2026, 7, 8), D("3"))],
                              "cadence string, taken_at date, commit_total decimal(18,2)")
    got = {(r.cadence, r.taken_at.day): (r.moved, r.first_of_cadence) for r in forecast.prior_snapshot(s).collect()}
    assert got == {("weekly", 1): (None, True), ("monthly", 2): (None, True), ("weekly", 8): (D("2.00"), False)}


def test_one_lead_per_tier_and_blocked_ones_never_show(spark):
    d = lambda n: DAY - dt.timedelta(days=n)
    base = dict(company="c", email="e", status="Working", marketing_opt_out=False, direct_opt_out=False, bounced=False, left_company=False,
                in_sequence=False, sequence_next=None, replied_to_sequence=False, last_activity=d(40), last_inbound=None, created=d(50), source=9)
    rows = [dict(base, lead_id=1, replied_to_sequence=True, in_sequence=True, sequence_next=d(-3)), dict(base, lead_id=2, source=1, last_inbound=d(2), last_activity=d(2)),
            dict(base, lead_id=3, last_activity=d(10)), dict(base, lead_id=4, status="New", last_activity=None), dict(base, lead_id=5),
            dict(base, lead_id=6, replied_to_sequence=True, direct_opt_out=True), dict(base, lead_id=7, in_sequence=True, sequence_next=d(-3))]
    schema = ("lead_id long, name string, company string, email string, status string, marketing_opt_out boolean, direct_opt_out boolean, bounced boolean, left_company boolean,"
              "in_sequence boolean, sequence_next date, replied_to_sequence boolean, last_activity date, last_inbound date, created date, source long")
    df = spark.createDataFrame([tuple(dict(r, name=f"n{r['lead_id']}")[c.split()[0]] for c in schema.split(",")) for r in rows], schema)
    got = leads.lead_triage(df, DAY.isoformat(), [1]).collect()
    assert [(r.tier, r.lead_id) for r in got if r.lead_id] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert [r.leads for r in got if r.lead_id is None] == [1]


def test_calendar_copy_is_one_meeting(spark):
    cols = "day date, kind string, email string, opp_id long, activity_id long"
    a = spark.createDataFrame([(DAY, "meeting", "x", 1, 1)], cols)
    assert meetings.activity_union(a, a.withColumn("activity_id", F.lit(2).cast("long")), a.limit(0)).collect()[0].copies == 2


def test_seed_refuses_rows_and_refresh_keeps_local_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "n1"), (2, "b", "n2")], "id int, stage string, notes string")
    sinks.seed_registry(df, str(tmp_path / "r"))
    with pytest.raises(sinks.RegistryNotEmpty):
        sinks.seed_registry(df, str(tmp_path / "r"))
    src = spark.createDataFrame([(2, "c"), (3, "d")], "id int, stage string")
    once = sync.refresh_merge(df, src, "id", {"stage": "crm", "notes": "local"})
    twice = sync.refresh_merge(once, src, "id", {"stage": "crm", "notes": "local"})
    want = {(1, "a", "n1"), (2, "c", "n2"), (3, "d", None)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == want


def test_dirty_export(spark, tmp_path):
    body = 'Record ID,Name,Created,Opted\r\n001000000000001QAB,"Caf\xe9 \x80",3/7/2026,1\r\n001000000000002,B,2026-03-08,true\r\n,C,1/1/2026,0\r\nGrand Totals,2,,\r\n'
    (tmp_path / "e.csv").write_bytes(body.encode("iso-8859-1"))
    good, skipped = readers.read_export(
        spark, str(tmp_path), ["Record ID", "Name", "Created", "Opted"],
        {"Record ID": ("crm_id", "id"), "Name": ("name", "string"), "Created": ("created", "date"), "Opted": ("opted", "boolean")}, "Record ID")
    assert {tuple(r) for r in good.collect()} == {("001000000000001", "Café €", dt.date(2026, 3, 7), True), ("001000000000002", "B", dt.date(2026, 3, 8), True)}
    assert skipped.count() == 2


def test_broken_line_is_kept(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "r.csv").write_text("id,stage\n1,Won\nx,Lost\n")
    rows = readers.read_registry(spark, str(tmp_path), T.StructType([T.StructField("id", T.LongType()), T.StructField("stage", T.StringType())])).collect()
    assert [(r.id, r._bad) for r in rows] == [(1, None), (None, "x,Lost")]


def test_transcript_files_split_into_turns(spark, tmp_path):
    (tmp_path / "2026-08-01-acme.txt").write_text("Jane Doe: hello\nmore words\nOur Rep: we will send it by friday\nnote: lower case is no speaker")
    got = readers.read_transcripts(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r.meeting_id, r.turn, r.speaker) for r in got][:2] == [("2026-08-01-acme", 0, "Jane Doe"), ("2026-08-01-acme", 1, "Our Rep")]
    assert got[0].text == "hello\nmore words"


def test_manifest_hashes_large_files_in_blocks(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "y.bin").write_bytes(b"z")
    got = {r.rel: (r.sha256, r.bytes) for r in readers.content_manifest(spark, str(tmp_path), "*.bin", in_memory=10).collect()}
    assert got == {"a/x.bin": (hashlib.sha256(b"abc" * 1000).hexdigest(), 3000), "y.bin": (hashlib.sha256(b"z").hexdigest(), 1)}


def test_rules_are_rows(spark):
    df = spark.createDataFrame([(i, "Won" if i % 2 else "Open", i * 10.0, dt.date(2026, 7, 1), None if i == 3 else "x") for i in range(6)], "id int, stage string, amount double, day date, champion string")
    rules = spark.createDataFrame(
        [("a", "stage", "=", "X", "auto", 1, True), ("b", "amount", ">", "5", "loud", None, True), ("c", "mood", "=", "x", "review", None, True), ("d", "amount", "like", "5", "review", 0, True),
         ("e", "stage", "=", "Won", "auto", None, True), ("f", "stage", "=", "Won", "review", 2, True), ("f", "amount", ">=", "10", "review", 2, True), ("g", "champion", "is empty", None, "manual", None, True),
         ("h", "stage", "<>", "Won", "review", None, False), ("i", "amount", "<", "many", "review", None, True)],
        "rule_id string, field string, op string, value string, level string, daily_cap int, active boolean")
    fields = spark.createDataFrame([(c,) for c in df.columns], "field string")
    lists = spark.createDataFrame([("stage", "Won"), ("stage", "Open")], "field string, value string")
    faults = tasks.rule_faults(rules, fields, lists)
    assert sorted((r.rule_id, r.fault) for r in faults.collect()) == [
        ("a", "unknown value"), ("b", "unknown level"), ("c", "unknown field"), ("d", "cap below one"), ("d", "unknown comparison"), ("e", "no daily cap")]
    got = tasks.rule_engine(df, rules, faults, "id", F.col("day"), F.col("amount"))
    assert sorted((r.rule_id, r.record_id, r.level, r["rank"]) for r in got.collect()) == [("f", 3, "review", 2), ("f", 5, "review", 1), ("g", 3, "manual", None)]
    assert tasks.rule_engine(df, rules.filter("false"), faults, "id", F.col("day"), F.col("amount")).count() == 0


def test_a_source_that_repeats_a_key_doubles_no_row(spark):
    local = spark.createDataFrame([(1, "a", "mine"), (2, "b", "mine")], "id int, stage string, note string")
    source = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n"), (None, "n")], "id int, stage string")
    got = sorted(map(str, map(tuple, sync.refresh_merge(local, source, "id", {"stage": "crm"}).collect())))
    assert got == sorted(map(str, [(1, "y", "mine"), (2, "b", "mine"), (3, "z", None), (None, "n", None), (None, "n", None)]))


def test_mentions_say_where(spark):
    comp = spark.createDataFrame([(1, "Acme Cloud", "acme;a.c."), (2, "Beta", None), (3, "Jira", None)], "competitor_id int, name string, aliases string")
    notes = spark.createDataFrame([(1, "They like ACME, not Jira"), (2, "nothing"), (3, None)], "opp_id int, text string")
    stack = spark.createDataFrame([(1, "Jira; Beta"), (2, "Betamax"), (3, "a c")], "opp_id int, value string")
    losses = spark.createDataFrame([(2, "Lost to beta on price"), (1, None)], "opp_id int, text string")
    got = {(r.opp_id, r.competitor_id): r.sources for r in competitors.competitor_mentions(notes, comp, exclude=["JIRA"], stack=stack, losses=losses).collect()}
    assert got == {(1, 1): ["text"], (1, 2): ["picklist"], (2, 2): ["loss reason"], (3, 1): ["picklist"]}


def test_route_lists_are_shared(spark):
    day = dt.date(2027, 1, 1)
    able = spark.createDataFrame([(1, D("0.10"), "5", None, day, None), (2, D("0.20"), "5;6", "A", day, "Reseller"), (3, D("0.05"), "6", "B", day, "Distributor")],
                                 "partner_id long, margin_pct decimal(5,2), countries string, segments_served string, enabled_until date, roles_supported string")
    able = partners.able_partners(able, "2026-08-01")
    accounts = spark.createDataFrame([(1, 5, "A"), (2, 6, "A"), (3, 6, "B")], "account long, country int, segment string")
    regs = spark.createDataFrame([(1, 2), (3, 3)], "customer long, partner_id long")
    opps = spark.createDataFrame([(i, i, D("100"), True, None) for i in (1, 2, 3)], "opp_id long, account long, amount decimal(18,2), is_open boolean, partner_id long")
    areas, known = partners.route_areas(accounts, able), partners.route_known(regs, able)
    got = {r.opp_id: (r.known_partners, r.area_partners, r.partner_id, r.existing_relation, r.net_amount) for r in partners.route_deal(opps, accounts, areas, known).collect()}
    assert got == {1: (1, 2, 2, True, D("80.00")), 2: (0, 1, 2, False, D("80.00")), 3: (0, 0, None, False, None)}
    assert [(r["rank"], r.partner_id) for r in areas.filter("country = '5'").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [(r.opp_id, r["rank"], r.partner_id) for r in partners.route_top(opps, accounts, areas, known, 1).orderBy("opp_id").collect()] == [(1, 1, 2), (2, 1, 2)]


def test_whole_manifest_has_every_document(spark, tmp_path):
    import hashlib

    from dealgrid.plans import catalog

    rows = [(k, None if k == 3 else f"text {k}") for k in range(1, 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.folder: (r.sha256, r.bytes) for r in catalog.QUERIES["content_manifest_whole"](spark, str(tmp_path)).collect()}
    want = {f"doc={k}": ((t or "") + "\n").encode() for k, t in rows}
    assert got == {k: (hashlib.sha256(b).hexdigest(), len(b)) for k, b in want.items()}


def test_converted_quotes_round_once(spark):
    """A quotient a little under half a cent is rounded down, one at half a cent up."""
    from dealgrid.operators import quotes as qt

    nets = {1: 1922941, 2: 25_000_000, 3: -1922941}
    totals = spark.createDataFrame([(k, D(v) / 100) for k, v in nets.items()], "quote_id long, net decimal(18,2)")
    quotes = spark.createDataFrame([(k, k, "EUR") for k in nets], "quote_id long, opp_id long, currency string")
    opps = spark.createDataFrame([(k, D("1"), "USD") for k in nets], "opp_id long, amount decimal(18,2), currency string")
    rates = spark.createDataFrame([("EUR", D("1.07526882"), "crm", dt.date(2000, 6, 1))], "currency string, rate decimal(18,8), source string, effective_from date")
    got = {r.quote_id: r.net_in_deal_currency_cents for r in qt.quote_vs_opportunity(totals, quotes, opps, rates, "2001-08-02").collect()}
    down = 1922941 * 107526882 // 10**8
    assert got == {1: down, 2: (25_000_000 * 107526882 * 2 + 10**8) // (2 * 10**8), 3: -down}


def test_every_candidate_of_a_deal_is_listed(spark):
    """Known partners first, then by net, to the last one of the area."""
    areas = spark.createDataFrame([("5", "A", k, D("0.01") * k, 10 + k) for k in range(1, 6)], "country string, segment string, rank int, margin_pct decimal(5,2), partner_id long")
    known = spark.createDataFrame([(1, 1, D("0.03"), 13), (1, 2, D("0.50"), 99), (8, 1, D("0.50"), 98)], "account long, rank int, margin_pct decimal(5,2), partner_id long")
    accounts = spark.createDataFrame([(1, 5, "A"), (2, 5, "A")], "account long, country int, segment string")
    opps = spark.createDataFrame([(7, 1, D("100"), True, None), (8, 1, D("50"), True, None), (9, 2, D("100"), True, None), (10, 2, D("1"), False, None)], "opp_id long, account long, amount decimal(18,2), is_open boolean, partner_id long")
    rows = partners.route_candidates(opps, accounts, areas, known).orderBy("opp_id", "rank").collect()
    assert [(r["rank"], r.partner_id) for r in rows if r.opp_id == 7] == [(1, 13), (2, 99), (3, 11), (4, 12), (5, 14), (6, 15)]
    assert [(r.partner_id, r.net_amount) for r in rows if r.opp_id == 8][:2] == [(13, D("48.50")), (99, D("25.00"))]
    assert [r.partner_id for r in rows if r.opp_id == 9] == [11, 12, 13, 14, 15] and {r.opp_id for r in rows} == {7, 8, 9}


def test_open_impacts_are_listed(spark):
    from dealgrid.operators import competitors

    day = dt.date(2001, 7, 20)
    signals = spark.createDataFrame([(1, 1, day, "b"), (2, 1, day, "a"), (3, 1, day, "b"), (4, 1, day, "No impact"), (5, 1, dt.date(2001, 7, 1), "old")], "signal_id long, competitor_id long, event_date date, impact string")
    cards = spark.createDataFrame([(1, dt.date(2001, 7, 10)), (2, dt.date(2001, 7, 10))], "competitor_id long, researched date")
    got = {r.competitor_id: (r.signals_since_battlecard, r.open_impacts) for r in competitors.competitor_activity(signals, cards, "2001-08-02").collect()}
    assert got == {1: (4, ["a", "b"]), 2: (0, None)}


def test_uncapped_candidates_are_ranked(spark, monkeypatch):
    """By falling score, then id; the same whether a rule's candidates are cut along their scores or not."""
    from dealgrid.operators import sequences, tasks

    day, nan = dt.date(2001, 1, 1), float("nan")
    rows = [("free", day, i, float(i % 37)) for i in range(400)] + [("free", day, 900, None), ("free", day, 901, nan), ("capped", day, 1, 1.0), (None, None, 1, 2.0), (None, None, 2, 3.0)]
    raised = spark.createDataFrame(rows, "rule_id string, day date, record_id long, score double")
    want = [901, *sorted(range(400), key=lambda i: (-(i % 37), i)), 900]
    for hot in (sequences.HOT_ROWS, 10):
        monkeypatch.setattr(sequences, "HOT_ROWS", hot)
        got = tasks.task_caps(raised, {"capped": 2}).collect()
        assert [r.record_id for r in sorted((r for r in got if r.rule_id == "free"), key=lambda r: r["rank"])] == want
        assert [r["rank"] for r in sorted((r for r in got if r.rule_id == "free"), key=lambda r: r["rank"])] == list(range(1, 403))
        assert sorted((r.record_id, r["rank"]) for r in got if r.rule_id is None) == [(1, 2), (2, 1)]


def test_small_files_share_tasks(spark, tmp_path):
    """Hundreds of small files are no reason for dozens of tasks, and the setting for that goes when they are read."""
    import hashlib

    for k in range(400):
        (tmp_path / f"f{k}.txt").write_text(f"A: {k}")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    manifest = readers.content_manifest(spark, str(tmp_path), "*.txt")
    turns = readers.read_transcripts(spark, str(tmp_path))
    assert manifest.rdd.getNumPartitions() <= 10 and turns.rdd.getNumPartitions() <= 10
    assert {r.rel: r.sha256 for r in manifest.collect()} == {f"f{k}.txt": hashlib.sha256(f"A: {k}".encode()).hexdigest() for k in range(400)}
    assert {(r.meeting_id, r.speaker, r.text) for r in turns.collect()} == {(f"f{k}", "A", str(k)) for k in range(400)}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_claims_are_joined_once(spark):
    """Every kind of finding comes from one pass over the submissions and their claims."""
    day = dt.date(2001, 8, 1)
    regs = spark.createDataFrame([("c1", 1, "Reseller", day, 90), ("c1", 2, "Distributor", day, 90)], "customer_key string, partner_id long, role string, approved date, protection_days int")
    subs = spark.createDataFrame([(1, "c1", 1, "Reseller"), (2, "c1", 3, "Reseller")], "submission_id long, customer_key string, partner_id long, role string")
    for fn, want in ((partners.conflict_teaming, {(1, "teaming"), (1, "already holds this tier"), (2, "teaming")}), (partners.conflict_same_tier, {(2, "same tier claimed")})):
        out = fn(subs, regs, "2001-08-02")
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
        assert {(r.submission_id, r.finding) for r in out.collect()} == want and out.count() == len(want)


def test_manifest_leaves_listing_and_file_writing_to_tasks(spark, tmp_path):
    """Spark's writer makes a checksum file and a process for each file, its reader a task for each folder and a name on the driver for each file."""
    import hashlib

    rows = [(k, f"text {k}\nß") for k in range(1500)] + [(7, "again"), (None, None), (None, "x")]
    top = tmp_path / "a b%20+"
    sinks.write_files(spark.createDataFrame(rows, "doc long, text string"), "doc", "text", str(top))
    files = [p for p in top.rglob("*") if p.is_file()]
    assert len(files) == 1501 and not any(p.suffix == ".crc" or p.name.startswith(".") for p in files)
    assert max(sum(1 for _ in p.iterdir()) for p in top.rglob("*") if p.is_dir()) <= 1000
    lines = {f"doc={k}": f"{t}\n".encode() for k, t in rows[:1500]} | {"doc=7": "again\ntext 7\nß\n".encode(), "doc=__HIVE_DEFAULT_PARTITION__": b"\nx\n"}
    for hidden in (".x.txt", "_x.txt", "empty.txt", "_dir/x.txt"):
        (top / hidden).parent.mkdir(exist_ok=True)
        (top / hidden).write_text("" if hidden == "empty.txt" else "x")
    (top / "deep" / "a=1" / top.name).mkdir(parents=True)
    (top / "deep" / "a=1" / top.name / "y.txt").write_text("y")
    got = {r.rel: (r.sha256, r.bytes) for r in readers.content_manifest(spark, str(top), "*.t?t").collect()}
    assert got.pop(f"deep/a=1/{top.name}/y.txt") == (hashlib.sha256(b"y").hexdigest(), 1)
    assert {k.split("/")[-1].removesuffix(".txt"): v for k, v in got.items()} == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in lines.items()}


def test_manifest_of_a_store_that_only_spark_reads(spark, tmp_path):
    """Such files are listed, read and written by Spark, with the same result."""
    from dealgrid.session import task_folder

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    assert task_folder(spark, "viewfs://kept/in/a") is None and task_folder(spark, str(tmp_path / "none")) is None
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "doc long, text string")
    manifests = []
    for path in ("viewfs://kept/in/a", str(tmp_path / "b")):
        sinks.write_files(df.fillna("", ["text"]), "doc", "text", path)
        manifests.append(sorted((re.search("doc=[0-9A-Z_]+", r.rel)[0], r.sha256, r.bytes) for r in readers.content_manifest(spark, path, "*.txt").collect()))
    assert manifests[0] == manifests[1] and len(manifests[0]) == 3


def test_route_candidates_rank_no_list_for_an_account(spark, monkeypatch):
    """Every deal gets every partner of its account and area, of the account first, each once; only the lists of areas and what accounts have are ranked."""
    offered = [(p, D(p % 4) / 10, p % 3) for p in range(40)] + [(5, D("0.90"), 1)]  # one partner comes with two margins
    areas = spark.createDataFrame([(f"c{c}", "A", i, m, p) for i, (p, m, c) in enumerate(offered)] + [(None, "A", 1, D("0.10"), 99)], "country string, segment string, rank int, margin_pct decimal(5,2), partner_id long")
    has = [(a, p, D(p % 4) / 10) for a in range(0, 30, 2) for p in (a, a + 1, a + 2, 77)] + [(0, 77, D("0.20")), (500, 1, D("0.10"))]
    known = spark.createDataFrame([(a, 1, p, m) for a, p, m in has], "account long, rank int, partner_id long, margin_pct decimal(5,2)")
    # An account in two places, one in none, one without an area.
    where = [(a, f"c{a % 3}", "A") for a in range(30)] + [(4, "c0", "A"), (30, None, "A"), (31, "c9", "A"), (8, None, None)]
    opps = [(i, i % 33, D(100 + i), i % 5 > 0, 1 if i % 7 == 0 else None) for i in range(120)] + [(3, 3, D("50"), True, None), (200, None, D("1"), True, None)]
    accounts = spark.createDataFrame(where, "account long, country string, segment string")
    want = []
    for i, a, amount, is_open, partner in opps:
        places = [(c, s) for x, c, s in where if x == a] if is_open and partner is None else []
        margins, mine = {}, {p for x, p, _ in has if x == a}
        for p, m in [(p, m) for p, m, c in offered for place in places if place == (f"c{c}", "A")] + [(p, m) for x, p, m in has if x == a]:
            margins[p] = max(m, margins.get(p, m))
        listed = sorted(margins, key=lambda p: (p not in mine, margins[p], p))
        want += [(i, k, p, p in mine, (amount * (1 - margins[p])).quantize(D("0.01"))) for _ in places for k, p in enumerate(listed, 1)]
    ranked, rank = [], partners.top_per_key
    monkeypatch.setattr(partners, "top_per_key", lambda df, *a: (ranked.append(df.count()), rank(df, *a))[1])
    monkeypatch.setattr(partners, "ROUTE_BLOCK", 3, raising=False)
    got = partners.route_candidates(spark.createDataFrame(opps, "opp_id long, account long, amount decimal(18,2), is_open boolean, partner_id long"), accounts, areas, known)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
    assert max(ranked) < 100
