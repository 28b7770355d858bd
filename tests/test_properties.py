"""The balanced plans against the plain ones, and laws that hold for any data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dealgrid.operators import fx, market, sequences, text_match as tm
from dealgrid.operators.clusters import components
from dealgrid.operators.sequences import asof_by_day, ordered_history, top_per_key
from dealgrid.operators.sync import numbered_from
from dealgrid.operators.tasks import provenance_impact
from dealgrid.session import shared_folder


def history(spark, n=400, keys=5):
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(keys), rng.randrange(40), i, rng.choice("abc")) for i in range(n)]
    rows += [(None, d, 1000 + d, "n") for d in range(9)]
    return spark.createDataFrame(rows, "k int, d int, i int, v string")


@pytest.mark.parametrize(("dates", "hot"), [(False, 3), (True, 3), (True, 100), (False, 10**6)])
def test_history_against_brute_force(spark, monkeypatch, dates, hot):
    """Over numbers, a bucket each, and over dates of several months; one key holds half of all rows; all, some or no keys are cut."""
    monkeypatch.setattr(sequences, "HOT_ROWS", hot)
    df = history(spark)
    if dates:
        df = df.withColumn("d", F.date_add(F.lit("2001-01-20").cast("date"), F.col("d") * 3))
    seq = ordered_history(df, keys=["k"], order=["d", "i"], bucket=F.col("d"), prev={"p": "v", "p3": ("i", 3)}, following={"n": "v", "nd": "d"}, number="no")
    rows, want = sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:])), set()
    for j, (k, d, i, v) in enumerate(rows):
        before = rows[j - 1] if j and rows[j - 1][0] == k else None
        after = rows[j + 1] if j + 1 < len(rows) and rows[j + 1][0] == k else None
        third = rows[j - 3] if j > 2 and rows[j - 3][0] == k else None
        want.add((k, d, i, v, before and before[3], third and third[2], after and after[3], after and after[1], 1 + sum(r[0] == k for r in rows[:j])))
    assert {tuple(r) for r in seq.select("k", "d", "i", "v", "p", "p3", "n", "nd", "no").collect()} == want
    alone = ordered_history(df, keys=["k"], order=["d", "i"], bucket=F.col("d"), number="no")
    assert {(r.k, r.d, r.i, r.no) for r in alone.collect()} == {(x[0], x[1], x[2], x[-1]) for x in want}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_against_brute_force(spark, strict, forward):
    rng = random.Random(3)
    left = [(i, rng.randrange(4), rng.randrange(20)) for i in range(60)] + [(99, 1, None)]
    right = [(rng.randrange(4), rng.randrange(20), rng.randrange(100)) for _ in range(40)]
    got = asof_by_day(
        spark.createDataFrame(left, "id int, k int, d int"), spark.createDataFrame(right, "k int, day int, v int"), ["k"], "d", "day", F.struct("day", "v"), "hit", strict, forward)

    def want(k, d):
        if d is None:
            return None
        ok = [(day, v) for kk, day, v in right if kk == k and ((day > d or (day == d and not strict)) if forward else (day < d or (day == d and not strict)))]
        return (min(ok) if forward else max(ok)) if ok else None

    for r in got.collect():
        assert (tuple(r.hit) if r.hit else None) == want(r.k, r.d)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_near_names_find_every_pair(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 6))) for _ in range(80)})

    df = spark.createDataFrame([(w,) for w in words], "name string")
    for limit in (1, 2):
        got = {(r.left_name, r.right_name, r.distance) for r in tm.near_names(df, df, limit).collect()}
        assert got == {(a, b, distance(a, b)) for a in words for b in words if a != b and distance(a, b) <= limit}


def test_similar_names_against_brute_force(spark):
    """Names that share a rare word and differ in some letters, or in one letter anywhere; a word in most names brings none together."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 6)))
    pool = [word() for _ in range(25)]
    name = lambda: " ".join(["acct"] * (rng.random() < 0.7) + rng.sample(pool, rng.randint(1, 3)))
    left, right = sorted({name() for _ in range(60)}), sorted({name() for _ in range(80)})
    right += [n + "x" for n in left[:5]] + [left[6]]
    right = sorted(set(right))
    count = {}
    for n in right:
        for w in set(n.split()):
            count[w] = count.get(w, 0) + 1
    rarest = lambda n: min((count.get(w, 0), w) for w in n.split())[1]
    want = set()
    for a in left:
        for b in right:
            d = distance(a, b)
            near = (rarest(a) in b.split() or rarest(b) in a.split()) and d <= max(len(a), len(b)) * 0.25 // 1
            if a != b and (near or d == 1):
                want.add((a, b, d))
    frame = lambda names: spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string")
    got = tm.similar_names(frame(left), frame(right)).collect()
    assert {(r.left_name, r.right_name, r.distance) for r in got} == want and len(got) == len(want) > 5
    assert all(abs(r.score - (1 - r.distance / max(len(r.left_name), len(r.right_name)))) < 1e-12 for r in got)


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 30)] + [(5, 5), (None, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_fit_counts_against_brute_force(spark):
    rng = random.Random(8)
    draw = lambda: [rng.choice([None, "a", "b"]), rng.choice(["s", "t"]), rng.choice(["i", "j", None]), rng.choice(["p", "q"])]
    signals, deals = [(i, *draw()) for i in range(12)], [(i, float(i), *draw()) for i in range(60)]
    tags = "segment string, size string, interest string, pain string"
    got = {(r.signal_id, r.fit_class): (r.hits, r.at_least, r.exactly, r.largest_deal) for r in market.signal_fit(
        spark.createDataFrame(signals, f"signal_id int, {tags}"), spark.createDataFrame(deals, f"opp_id int, amount double, {tags}")).collect()}
    want = {}
    for s in signals:
        for mask in range(1, 16):
            bits = [i for i in range(4) if mask >> i & 1]
            if any(s[1 + i] is None for i in bits):
                continue
            common = [(d[1], d[0], {i for i in range(4) if s[1 + i] is not None and s[1 + i] == d[2 + i]}) for d in deals]
            over = [(a, i, c) for a, i, c in common if set(bits) <= c]
            if over:
                label = "|".join(f"{market.FIT_TAGS[i]}={s[1 + i]}" for i in bits)
                want[s[0], label] = (len(bits), len(over), sum(c == set(bits) for *_, c in over), max(over[k][:2] for k in range(len(over)))[1])
    assert got == want
    members = market.fit_deals(spark.createDataFrame(deals, f"opp_id int, amount double, {tags}")).groupBy("fit_class").count().collect()
    assert all(n == {r.fit_class: r["count"] for r in members}[label] for (_, label), (_, n, _, _) in want.items())


def test_events_of_one_company(spark):
    """Two events of one day stay two; one told again a day later in nearly the same words is one; so are chains and very many copies, but not a month later."""
    from datetime import date, timedelta

    day, words = date(2001, 7, 1), [f"word{k}" for k in range(60)]
    say = lambda *drop: " ".join(w for k, w in enumerate(words) if k not in drop)
    rows = [(1, 0, "card theft at the store " + say()), (2, 0, "stolen laptop " + " ".join(f"other{k}" for k in range(40))), (3, 1, "card theft in a store " + say(3)),
            (4, 3, say(1, 2, 4, 5)), (5, 40, say(1, 2)), (6, 6, say(7, 8, 9, 10, 11))]
    rows += [(100 + k, 0, say(k % 60) + f" copy{k}") for k in range(300)]
    schema = "signal_id int, event_date date, confidence string, signal_type string, entity_url string, entity_name string, text string"
    signals = spark.createDataFrame([(i, day + timedelta(d), "Reported", "breach", None, "Acme Inc", t) for i, d, t in rows] + [(900, day, "Rumour", "merger", None, "Acme", say(5)), (901, None, "Rumour", "breach", None, "Acme", say(6))], schema)
    got = {r.signal_id: r.event_id for r in market.event_members(signals).collect()}
    assert {i for i, e in got.items() if e == 1} == {1, 3, 4, 6, *range(100, 400)}
    assert got[2] == 2 and got[5] == 5 and got[900] == 900 and got[901] == 901


def test_events_move_their_texts_few_times(spark):
    """What is shuffled and written to find the events of long texts stays below eight times the texts, with no table broadcast."""
    from datetime import date

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = [" ".join(word() for _ in range(300)) for _ in range(500)]
    rows = [(i + 1000 * copy, date(2001, 7, 1), "Reported", "breach", None, f"Acme {i % 9}", t + " again" * copy) for i, t in enumerate(texts) for copy in range(2)]
    signals = spark.createDataFrame(rows, "signal_id int, event_date date, confidence string, signal_type string, entity_url string, entity_name string, text string")
    store = spark._jsc.sc().statusStore()

    def moved():
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(stages.apply, range(stages.size()))}

    before = moved()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert market.event_members(signals).filter("event_id >= 1000").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    total = sum(n for stage, n in moved().items() if stage not in before)
    assert total < 8 * sum(len(r[-1]) for r in rows), total / sum(len(r[-1]) for r in rows)


def test_shuffles_follow_the_tables(spark, monkeypatch):
    """Shuffles start from partitions in proportion to the tables a query reads, and from the session's number for small ones."""
    from pathlib import Path

    from dealgrid.plans import registry

    sf_dir, wanted = "/root/testdata/sf0.001", lambda: spark.conf.get(registry.INITIAL_PARTITIONS, None)
    registry.Tables(spark, sf_dir).orders
    assert wanted() is None
    size = sum((Path(sf_dir) / f"{t}.parquet").stat().st_size for t in ("orders", "lineitem"))
    monkeypatch.setattr(registry, "PARTITION_BYTES", size // 40)
    tables = registry.Tables(spark, sf_dir)
    assert tables.orders.count() and tables.lineitem.count() and tables.orders.count()
    assert 40 <= int(wanted()) <= 41
    assert "hashpartitioning(o_custkey" in (plan := tables.orders.groupBy("o_custkey").count()._jdf.queryExecution().executedPlan().toString()) and f", {wanted()})" in plan
    registry.Tables(spark, sf_dir)
    assert wanted() is None


def test_signals_meet_all_kinds_of_records(spark):
    side = lambda rows: spark.createDataFrame(rows, "id int, name string, domain string")
    deals = side([(i, "Acme Robotics Ltd", "acme.com") for i in range(10, 15)] + [(20, "Zenith Partners", None)])
    index = market.record_index(deals, side([(30, "Acme Robotics", None)]), side([(40, "Zenith Partner", "zenith.org")]), side([(50, "Other", "x@acme.com"), (51, None, None)]))
    signals = spark.createDataFrame([(1, "https://www.acme.com/news", "Nobody"), (2, None, "Acme Robotic"), (3, None, "ZENITH PARTNERS, Inc."), (4, "none.org", "Unheard of"), (5, None, None)], "signal_id int, entity_url string, entity_name string")
    got = {(r.signal_id, r.related_type): (r.related_id, r.records, r.basis) for r in market.signal_account_link(signals, index).collect()}
    assert got == {
        (1, "opportunity"): (10, 5, "domain"), (1, "lead"): (50, 1, "domain"), (2, "opportunity"): (10, 5, "near name, review"), (2, "renewal"): (30, 1, "near name, review"),
        (3, "opportunity"): (20, 1, "name"), (3, "customer"): (40, 1, "near name, review")}


def test_term_hits_against_brute_force(spark):
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice(["Red", "blue,", "green", "big", "x-ray"]) for _ in range(rng.randint(0, 12)))) for i in range(50)]
    terms = [(1, "red"), (2, "big green"), (3, "x ray red"), (4, "absent")]
    got = {tuple(r) for r in tm.term_hits(spark.createDataFrame(texts, "key int, text string"), "key", "text", spark.createDataFrame(terms, "term_id int, phrase string")).collect()}

    def norm(s):
        return " " + " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split()) + " "

    assert got == {(i, t) for i, text in texts for t, p in terms if norm(p) in norm(text)}


def test_numbers_are_dense_and_in_order(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    got = {r.k: r.n for r in numbered_from(df, ["k"], F.lit(7).cast("long"), "n").collect()}
    assert got == {k: 8 + i for i, k in enumerate(sorted(ids))}


def test_impact_follows_chains_and_cycles(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (2, 4), (9, 8)], "child int, parent int")
    got = {(r.asset, r.depth) for r in provenance_impact(links, spark.createDataFrame([(1,)], "id int")).collect()}
    assert got == {(2, 1), (3, 2), (4, 3)}


def test_top_per_key_cuts_before_the_shuffle(spark):
    df = top_per_key(history(spark), ["k"], [F.col("d").desc(), F.col("i")], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_rates_take_the_bounded_way_only_when_small(spark):
    from datetime import date
    from decimal import Decimal

    rates = spark.createDataFrame([("EUR", Decimal("1.1"), "crm", date(2026, 1, 1))], "currency string, rate decimal(18,8), source string, effective_from date")
    df = spark.createDataFrame([("EUR", date(2026, 2, 1))], "currency string, d date")
    assert "BroadcastHashJoin" in fx.with_rate(df, rates, "d")._jdf.queryExecution().executedPlan().toString()
    assert fx.with_rate(df, rates, "d", max_rows=0).first().rate == fx.with_rate(df, rates, "d").first().rate


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from dealgrid.session import clear_scratch, cut_lineage

    clear_scratch(spark)
    df = cut_lineage(spark.range(10), "gone")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 10 and folder.exists()
    assert clear_scratch(spark) == 1 and not folder.exists() and clear_scratch(spark) == 0


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
