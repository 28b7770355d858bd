"""Competitors: mentions in whole texts, record, trend, signals and stale cards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import SAMPLE_FLOOR, guarded_rate, sample_note, split_list
from dealgrid.operators.sequences import ordered_history, top_per_key
from dealgrid.operators.text_match import near_names, phrase_key, term_hits


def spellings(competitors: DataFrame) -> DataFrame:
    """Name and aliases as rows."""
    names = F.array_union(F.array(F.col("name")), F.coalesce(split_list(F.col("aliases")), F.array().cast("array<string>")))
    return competitors.select(F.col("competitor_id").alias("term_id"), F.explode(names).alias("phrase"))


def _not_integrations(terms: DataFrame, integrations: Sequence[str]) -> DataFrame:
    if not integrations:
        return terms
    return terms.filter(~F.coalesce(phrase_key(F.col("phrase")).isin(*[e.lower() for e in integrations]), F.lit(False)))


def competitor_mentions(
    notes: DataFrame, competitors: DataFrame, exclude: Sequence[str] = (), stack: DataFrame | None = None, losses: DataFrame | None = None
) -> DataFrame:
    """(opp_id, competitor_id, sources) for every competitor a deal names, and where: loss reason, picklist, text.

    Texts and loss reasons are searched for every spelling. `stack` is a picklist of several values, opp_id and value, in which a value must be a spelling
    as a whole; `exclude` lists the names that are integrations, in any source. A loss reason is opp_id and text.
    """
    terms = _not_integrations(spellings(competitors), exclude)
    found = [term_hits(notes, "opp_id", "text", terms).withColumn("source", F.lit("text"))]
    if losses is not None:
        found.append(term_hits(losses, "opp_id", "text", terms).withColumn("source", F.lit("loss reason")))
    if stack is not None:
        values = stack.select("opp_id", F.explode(split_list(F.col("value"))).alias("_value"))
        whole = terms.select("term_id", phrase_key(F.col("phrase")).alias("_key")).distinct()
        found.append(values.withColumn("_key", phrase_key(F.col("_value"))).join(whole, "_key").select("opp_id", "term_id", F.lit("picklist").alias("source")))
    hits = reduce(DataFrame.unionByName, found)
    # At most one entry per source.
    return hits.groupBy("opp_id", F.col("term_id").alias("competitor_id")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def unknown_names(named: DataFrame, known: DataFrame) -> DataFrame:
    """Names seen on deals that no registry row covers, with the number of deals."""
    return named.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("deals")).join(
        known.select("name"), "name", "left_anti")


def competitor_record(mentions: DataFrame, opps: DataFrame, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Won, lost and open per competitor; a deal counts for each competitor it names."""
    j = mentions.join(opps.select("opp_id", "stage", "is_open"), "opp_id")
    won, decided = F.count_if(F.col("stage") == "Closed Won"), F.count_if(~F.col("is_open"))
    return j.groupBy("competitor_id").agg(
        won.alias("won"), F.count_if(F.col("stage") == "Closed Lost").alias("lost"), F.count_if("is_open").alias("open_deals"),
        guarded_rate(won, decided, floor).alias("win_rate"), sample_note(won, decided, floor).alias("sample_note"))


def competitor_trend(mentions: DataFrame, opps: DataFrame, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Win rate of each quarter against the quarter before it in which deals were decided.

    Deals fold to one row per competitor and quarter before the comparison.
    """
    closed = opps.filter(~F.col("is_open")).select("opp_id", "stage", F.date_trunc("quarter", "close_date").cast("date").alias("quarter"))
    q = mentions.join(closed, "opp_id").groupBy("competitor_id", "quarter").agg(
        F.count_if(F.col("stage") == "Closed Won").alias("won"), F.count(F.lit(1)).alias("decided"))
    seq = ordered_history(q, ["competitor_id"], ["quarter"], F.col("quarter"), prev={"_pw": "won", "_pd": "decided"})
    now, before = guarded_rate(F.col("won"), F.col("decided"), floor), guarded_rate(F.col("_pw"), F.col("_pd"), floor)
    trend = F.when(now.isNull() | before.isNull(), "Too few deals").when(now > before, "Up").when(now < before, "Down").otherwise("Flat")
    return seq.select("competitor_id", "quarter", "won", "decided", trend.alias("trend"))


def competitor_signals(signals: DataFrame, competitors: DataFrame) -> DataFrame:
    """Signals per competitor: tagged ones, and untagged ones whose text names the competitor."""
    tagged = signals.filter(F.col("competitor_id").isNotNull()).select("signal_id", "competitor_id", F.lit("tagged").alias("basis"))
    bare = signals.filter(F.col("competitor_id").isNull()).select("signal_id", "text")
    found = term_hits(bare, "signal_id", "text", spellings(competitors)).select(
        "signal_id", F.col("term_id").alias("competitor_id"), F.lit("to be tagged").alias("basis"))
    return tagged.join(competitors.select("competitor_id"), "competitor_id", "left_semi").select("signal_id", "competitor_id", "basis").unionByName(found)


def competitor_displacement(opps: DataFrame, accounts: DataFrame) -> DataFrame:
    """Motion of each open deal: displacement where the account already runs a competitor."""
    flags = accounts.select("account", "runs_competitor")
    motion = F.when(F.col("runs_competitor").isNull(), "unknown").when(F.col("runs_competitor"), "displacement").otherwise("greenfield")
    return opps.filter("is_open").join(flags, "account", "left").select("opp_id", "account", motion.alias("motion"))


def open_impacts(signals: DataFrame, competitors: DataFrame) -> DataFrame:
    """What signals since each card was written say that is not on it: competitor_id, impact, signals, last_event. Free text, so one row for each wording."""
    since = signals.join(competitors.select("competitor_id", "researched"), "competitor_id").filter(F.col("event_date") > F.col("researched"))
    return since.filter(F.col("impact") != "No impact").groupBy("competitor_id", "impact").agg(F.count(F.lit(1)).alias("signals"), F.max("event_date").alias("last_event"))


def competitor_activity(signals: DataFrame, competitors: DataFrame, as_of: str) -> DataFrame:
    """Last signal, signals in 90 days and since the card, the latest one, and the impacts not yet on the card, each wording once (`open_impacts` counts them)."""
    day = F.lit(as_of).cast("date")
    cards = competitors.select("competitor_id", "researched")
    j = signals.filter(F.col("competitor_id").isNotNull()).join(cards, "competitor_id")
    since = F.col("event_date") > F.col("researched")
    sums = j.groupBy("competitor_id").agg(
        F.max("event_date").alias("last_signal_date"), F.count_if(F.datediff(day, F.col("event_date")) <= 90).alias("signals_90d"),
        F.count_if(since).alias("signals_since_battlecard"), F.max_by("signal_id", F.struct("event_date", "signal_id")).alias("latest_signal"))
    # Wordings are folded to one row each before a competitor's are listed.
    impacts = open_impacts(signals, competitors).groupBy("competitor_id").agg(F.array_sort(F.collect_list("impact")).alias("open_impacts"))
    j = competitors.select("competitor_id").join(sums, "competitor_id", "left").join(impacts, "competitor_id", "left")
    return j.select("competitor_id", "last_signal_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("signals_90d", "signals_since_battlecard")], "latest_signal", "open_impacts")


def stale_battlecards(competitors: DataFrame, signals: DataFrame, voiding: Sequence[str] = ("new capability",)) -> DataFrame:
    """Primary competitors with signals since the card was written, and whether one voids a win theme."""
    primary = competitors.filter(F.col("tier") == "Primary").select("competitor_id", "researched")
    j = signals.join(primary, "competitor_id").filter(F.col("event_date") > F.col("researched"))
    return j.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("signals_since"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"),
        F.bool_or(F.col("impact").isin(*voiding)).alias("voids_win_theme"))


def card_changes(signals: DataFrame, competitors: DataFrame, k: int | None = None) -> DataFrame:
    """The signals since each card was written, numbered from the newest; the newest `k` where that is given.

    All of them are numbered along their days, so a competitor with very many signals is many tasks' work.
    """
    since = signals.join(competitors.select("competitor_id", "researched"), "competitor_id").filter(F.col("event_date") > F.col("researched"))
    since = since.select("competitor_id", "signal_id", "event_date", "impact", (-F.unix_date("event_date")).alias("_back"))
    if k is None:
        top = ordered_history(since, ["competitor_id"], ["_back", "signal_id"], F.col("_back"), number="rank")
    else:
        top = top_per_key(since, ["competitor_id"], [F.col("_back"), F.col("signal_id")], k)
    return top.select("competitor_id", "rank", "signal_id", "event_date", "impact")


def alias_candidates(words: DataFrame, competitors: DataFrame, distance: int = 2) -> DataFrame:
    """Words of deal texts near a known spelling, for review."""
    known = spellings(competitors).select(phrase_key(F.col("phrase")).alias("name"))
    fresh = words.join(known, "name", "left_anti")
    return near_names(fresh, known, distance).select(
        F.col("left_name").alias("seen"), F.col("right_name").alias("candidate"), "distance")


def competitor_first_seen(dated_mentions: DataFrame) -> DataFrame:
    return dated_mentions.groupBy("opp_id", "competitor_id").agg(F.min("day").alias("first_seen"))


def rep_competitor_losses(mentions: DataFrame, opps: DataFrame, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Reps' share of losses to one competitor next to that competitor's share of all losses."""
    lost = opps.filter(F.col("stage") == "Closed Lost").select("opp_id", "owner")
    pairs = mentions.join(lost, "opp_id").groupBy("owner", "competitor_id").agg(F.count(F.lit(1)).alias("losses"))
    rep = pairs.groupBy(F.col("owner").alias("_owner")).agg(F.sum("losses").alias("_rep"))
    book = pairs.groupBy(F.col("competitor_id").alias("_cid")).agg(F.sum("losses").alias("_book"))
    every = pairs.agg(F.sum("losses").alias("n")).scalar()
    j = pairs.join(rep, F.col("owner").eqNullSafe(F.col("_owner"))).join(book, F.col("competitor_id") == F.col("_cid"))
    return j.select(
        "owner", "competitor_id", "losses", guarded_rate(F.col("losses"), F.col("_rep"), floor).alias("share"),
        F.try_divide(F.col("_book").cast("double"), every.cast("double")).alias("book_share"))
