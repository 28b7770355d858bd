"""Rows that earlier versions lost, merged or cut: blank keys, long terms, other scripts, dirty cells, missing caps."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealgrid.functions import columns as fn
from dealgrid.operators import competitors as cp
from dealgrid.operators import leads, market, partners, sync, tasks
from dealgrid.operators import text_match as tm
from dealgrid.sources import readers


def test_terms_of_any_length_and_script(spark):
    texts = spark.createDataFrame([
        (1, "The New York Times Sunday Magazine wrote."), (2, "Это новый рынок, да"), (3, "日本 の 会社 は"), (4, None), (5, " .. "), (6, "new   YORK\ntimes"),
    ], "k int, text string")
    terms = spark.createDataFrame([(1, "New York Times"), (2, "new york times sunday magazine"), (3, "Новый рынок"), (4, "日本 の"), (5, "..."), (6, None), (7, "york")], "term_id int, phrase string")
    got = {tuple(r) for r in tm.term_hits(texts, "k", "text", terms).collect()}
    assert got == {(1, 1), (1, 2), (1, 7), (2, 3), (3, 4), (6, 1), (6, 7)}
    watch = terms.select(F.col("term_id").alias("watch_id"), F.lit("Account").alias("kind"), F.col("phrase").alias("term"))
    assert market.watchlist_sweep(texts.withColumnRenamed("k", "signal_id"), watch).count() == 7
    names = spark.createDataFrame([(1, "Acme Cloud Services", "acme")], "competitor_id int, name string, aliases string")
    notes = spark.createDataFrame([(1, "they run acme cloud services"), (2, "acme"), (3, "cloud")], "opp_id int, text string")
    assert {r.opp_id for r in cp.competitor_mentions(notes, names).collect()} == {1, 2}


def test_company_names(spark):
    rows = spark.createDataFrame([("日本 Inc.",), ("The Group",), ("ООО «Компания»",), (None,), ("Société Générale SA",)], "n string")
    assert [r[0] for r in rows.select(fn.norm_company(F.col("n"))).collect()] == ["日本", None, "ооо компания", None, "société générale"]


def test_blank_names_link_nothing(spark):
    signals = spark.createDataFrame([(1, None, "The Group"), (2, None, None), (3, None, "日本")], "signal_id int, entity_url string, entity_name string")
    accounts = spark.createDataFrame([(7, "Holdings Inc", None), (8, "日本 Ltd", None)], "id int, name string, domain string")
    none = accounts.limit(0)
    got = {r.signal_id: (r.related_type, r.related_id, r.basis) for r in market.signal_account_link(signals, market.record_index(none, none, accounts, none)).collect()}
    assert got == {3: ("customer", 8, "name")}


SIDE = "id long, a string"


def test_rows_without_a_key_are_compared_alone(spark):
    local = spark.createDataFrame([(None, "x"), (None, "y"), (1, "p"), (1, "q"), (2, "s")], SIDE)
    source = spark.createDataFrame([(1, "q"), (2, "s"), (None, "z")], SIDE)
    got = sorted((str(r.id), r.field, r.sync_class, str(r.local_value)) for r in sync.verify_sync(local, source, source, "id", ["a"]).collect())
    assert got.count(("None", "a", "AHEAD", "x")) == 1 and got.count(("None", "a", "AHEAD", "y")) == 1
    assert ("1", "(record)", "DUPLICATE", "2") in got and len([g for g in got if g[0] == "None"]) == 4
    newest = sync.latest_record(local, "id", ["a"]).collect()
    assert sorted(str(tuple(r)) for r in newest) == sorted(map(str, [(None, "x"), (None, "y"), (1, "q"), (2, "s")]))


def test_write_guard_without_source_ids(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "b", 5), (3, None, 5)], "id int, sid string, m int")
    assert {r["check"]: r.n for r in sync.write_guard(rows, rows, "id", "sid", "m").collect()} == {"rows lost": 0, "edits reverted": 0, "ids renumbered": 0}
    assert {r["check"]: r.n for r in sync.write_guard(rows, rows.filter("id <> 3"), "id", "sid", "m").collect()}["rows lost"] == 1


@pytest.mark.parametrize("kind", ["text", "sparse"])
def test_upsert_on_any_key(spark, kind):
    rng = random.Random(4)
    keys = [f"{rng.randrange(10**6):04x}b" for _ in range(400)] if kind == "text" else [rng.randrange(1 << 60) for _ in range(2000)]
    keys = sorted(set(keys))
    schema = f"n long, k {'string' if kind == 'text' else 'long'}, v int"
    local = spark.createDataFrame([(i + 10, k, 0) for i, k in enumerate(keys[::2])], schema)
    incoming = spark.createDataFrame([(k, v) for k in keys for v in (1, 2)] + [(None, 7), (None, 8)], schema.split(", ", 1)[1])
    got = sync.upsert_by_key(local, incoming, "k", "n")
    rows = got.collect()
    assert len(rows) == len(keys) + 2 and len({r.n for r in rows}) == len(rows)
    old = {k: i + 10 for i, k in enumerate(keys[::2])}
    assert all(r.n == old[r.k] and r.v == 2 for r in rows if r.k in old)
    fresh = [r for r in sorted(rows, key=lambda r: r.n) if r.k not in old]
    assert [r.n for r in fresh] == list(range(10 + len(old), 10 + len(old) + len(fresh))) and [r.v for r in fresh[:2]] == [7, 8]
    assert [r.k for r in fresh[2:]] == keys[1::2]


def test_numbering_has_no_window_over_the_rows(spark):
    """The one window over everything sees a row per range, however sparse the keys are."""
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randrange(1 << 60),) for _ in range(5000)], "k long")
    numbered = sync.numbered_from(df, ["k"], F.lit(0).cast("long"), "n")
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 5001))
    ranges = numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")
    assert int(ranges) < 5000


LEAD = "lead_id int, crm_id string, email string, name string, company string"


def test_leads_need_name_and_company(spark):
    known = spark.createDataFrame([(1, None, None, "Ann Lee", None), (2, None, None, "Ann Lee", "Acme Inc"), (3, None, "a@x", "Ann Lee", "ACME"), (4, None, None, None, "Acme"), (5, None, None, None, None), (6, None, None, "", "Acme")], LEAD)
    incoming = spark.createDataFrame([(11, None, None, "Ann Lee", None), (12, None, None, "ann lee", "Acme"), (13, None, "A@X", None, None)], LEAD.replace("lead_id", "incoming_id"))
    matches = leads.match_leads(incoming, known)
    got = {r.incoming_id: (r.match_tier, r.candidate_id, r.candidates) for r in matches.collect()}
    assert got == {11: ("none", None, 0), 12: ("name and company", 2, 2), 13: ("email", 3, 1)}
    listed = {(r.match_tier, r.lead_id) for r in leads.match_candidates(matches, known).collect()}
    assert listed == {("name and company", 2), ("name and company", 3), ("email", 3)}
    assert [(r.first_id, r.other_id) for r in leads.duplicate_leads(known).collect()] == [(2, 3)]


def test_signals_without_words_stay_apart(spark):
    day = date(2001, 7, 1)
    rows = [(1, None, "a"), (2, "", "b"), (3, " ... ", "c"), (4, "!!", "d"), (5, "Breach at Acme", "acme"), (6, "acme: BREACH at", "other"), (7, "Quite other words", "acme")]
    signals = spark.createDataFrame([(i, day, "Reported", "breach", None, n, t) for i, t, n in rows], "signal_id int, event_date date, confidence string, signal_type string, entity_url string, entity_name string, text string")
    got = {r.signal_id: r.copies for r in market.dedup_signals(market.event_members(signals)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 7: 1}


def test_money(spark):
    cells = {"(1,234.50)": "-1234.50", "1.234,56": "1234.56", "$ 1,234": "1234.00", "12,5": "12.50", "-7": "-7.00", "7-": "-7.00", "1.234.567": "1234567.00", "1,23,4": None, "n/a": None, "1.5": "1.50", "EUR 3.000,00-": "-3000.00", "": None, "1,234,567.8": "1234567.80", "5.": "5.00"}
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", fn.parse_money(F.col("c")).alias("m")).collect()
    assert {r.c: None if r.m is None else str(r.m) for r in rows} == cells


def test_long_record_ids(spark):
    rows = spark.createDataFrame([("001A0000006Vm9r",), ("001A0000006Vm9rIAC",), ("x",), (None,)], "i string")
    assert [r[0] for r in rows.select(fn.norm_record_id(F.col("i"), "long")).collect()] == ["001A0000006Vm9rIAC", "001A0000006Vm9rIAC", "x", None]


def test_speakers(spark):
    text = "Speaker 1: hello\nand more\nJosé Álvarez: sí\nMaria-Luise von und zu Hohenstein (Legal): ja\nhttp://x: y\n李 小龍: 好"
    got = [(r.speaker, r.text) for r in readers.split_turns(spark.createDataFrame([(text, "raw/7.txt")], "value string, raw_path string")).orderBy("turn").collect()]
    assert got == [("Speaker 1", "hello\nand more"), ("José Álvarez", "sí"), ("Maria-Luise von und zu Hohenstein (Legal)", "ja\nhttp://x: y"), ("李 小龍", "好")]


def test_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "e.csv").write_text('Id,Note\n"006000000000001","two\nlines, ""quoted"""\n"AB-1",short\nTotal,\n', encoding="latin-1")
    good, skipped = readers.read_export(spark, str(tmp_path), ["Id", "Note"], {"Id": ("id", "string"), "Note": ("note", "string")}, "Id")
    assert [r.note for r in good.collect()] == ['two\nlines, "quoted"'] and skipped.count() == 2
    good, skipped = readers.read_export(spark, str(tmp_path), ["Id", "Note"], {"Id": ("id", "string")}, "Id", r"[0-9]+|[A-Z]+-[0-9]+")
    assert good.count() == 2 and skipped.count() == 1


def test_rates_of_both_conventions(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"convention":"base-per-unit","rates":{"EUR":1.25},"source":"m","effective_from":"2001-01-01"}\n{"rates":{"GBP":0.5},"source":"c","effective_from":"2001-01-01"}\n{"convention":"odd","rates":{"CHF":3},"source":"c","effective_from":"2001-01-01"}\n')
    got = {r.currency: r.rate for r in readers.read_fx_rates(spark, str(tmp_path)).collect()}
    assert got == {"EUR": Decimal("1.25"), "GBP": Decimal("2"), "CHF": None}


def test_rules_without_a_cap(spark):
    raised = spark.createDataFrame([(r, date(2001, 1, 1), i, float(i)) for r in ("capped", "free", None) for i in range(9)], "rule_id string, day date, record_id int, score double")
    count = lambda caps: {r.rule_id: r["count"] for r in tasks.task_caps(raised, caps).groupBy("rule_id").count().collect()}
    assert count({"capped": 2}) == {"capped": 2, "free": 9, None: 9} and count({}) == {"capped": 9, "free": 9, None: 9}


def test_roster_of_any_depth_and_circles(spark):
    users = spark.createDataFrame([(k, k - 1, True) for k in range(1, 8)] + [(20, 7, True), (7, 20, True), (0, 3, True)], "user_id int, manager int, active boolean")
    assert {r.rep for r in tasks.roster_from_hierarchy(users, 0).collect()} == {1, 2, 3, 4, 5, 6, 7, 20}
    assert {r.rep for r in tasks.roster_from_hierarchy(users, 0, 2).collect()} == {1, 2}


def test_exclusive_areas_are_lists(spark):
    partner = [(1, None, None, None, None, None), (2, None, None, None, None, "5; 6")]
    side = spark.createDataFrame(partner, "partner_id int, roles_supported string, countries string, segments_served string, excluded_accounts string, named_accounts string".replace("named_accounts string", "exclusive_territory string")).withColumn("named_accounts", F.lit(None).cast("string"))
    subs = spark.createDataFrame([(1, 1, 9, "Reseller", "5", "A"), (2, 1, 9, "Reseller", "7", "A"), (3, 2, 9, "Reseller", "6", "A")], "submission_id int, partner_id int, customer int, role string, country string, segment string")
    assert [(r.submission_id, r.finding) for r in partners.conflict_territory(subs, side).collect()] == [(1, "exclusive territory")]


def test_lists_hold_everything(spark):
    day = date(2001, 7, 1)
    signals = spark.createDataFrame([(i, 1, day, "x") for i in range(12)], "signal_id int, competitor_id int, event_date date, impact string")
    cards = spark.createDataFrame([(1, date(2001, 1, 1))], "competitor_id int, researched date")
    assert cp.card_changes(signals, cards).count() == 12 and cp.card_changes(signals, cards, 3).count() == 3


def test_schema_corrections(spark):
    local = spark.createDataFrame([("r", 1, "a", "string", None, "crm", "yes"), ("r", 2, "b", "string", None, "crm", "yes")], "registry string, column_no int, column_name string, column_type string, enum_values string, owner string, verify string")
    new = spark.createDataFrame([("r", 1, "a", "string", None, "local", "no", True, True), ("r", 2, "b", "string", None, "crm", "no", False, False)], "registry string, column_no int, column_name string, column_type string, enum_values string, owner string, verify string, owner_corrected boolean, verify_corrected boolean")
    got = {r.column_name: (r.owner, r.verify) for r in sync.schema_merge(local, new).collect()}
    assert got == {"a": ("local", "no"), "b": ("crm", "yes")}
