"""Meetings: match to a record, credit once, preparation, commitments, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import norm_domain
from dealgrid.operators.sequences import asof_by_day, ordered_history, spread_nulls

# Sentiments from best to worst; Unclear says nothing.
SENTIMENT_RANK = {"Positive": 3, "Neutral": 2, "Mixed": 1, "Negative": 0}
HEALTHY_STAGES = ("Validate", "Proposal", "Negotiate")


def meeting_match(meetings: DataFrame, accounts: DataFrame, opps: DataFrame, renewals: DataFrame, leads: DataFrame) -> DataFrame:
    """Link a meeting to the one record it fits; several or none go to review.

    A running contract wins only where the talk was about the contract. Without deal or contract a
    customer fits, or else a single lead of that domain. Every kind folds to counts per account or
    domain before the join.
    """
    domains = accounts.select(norm_domain(F.col("website")).alias("_d"), "account").groupBy("_d").agg(F.min("account").alias("_acct"))
    by_account = opps.groupBy(F.col("account").alias("_acct")).agg(
        F.count_if("is_open").alias("open_deals"), F.min(F.when(F.col("is_open"), F.col("opp_id"))).alias("_opp"),
        F.bool_or(F.col("stage") == "Closed Won").alias("_customer"))
    terms = renewals.filter(F.col("status") == "Active").groupBy(F.col("account").alias("_acct")).agg(
        F.count(F.lit(1)).alias("contracts"), F.min("renewal_id").alias("_ren"))
    people = leads.filter(F.col("email").isNotNull()).groupBy(norm_domain(F.col("email")).alias("_d")).agg(
        F.count(F.lit(1)).alias("leads"), F.min("lead_id").alias("_lead"))
    j = meetings.select("meeting_id", spread_nulls(norm_domain(F.col("attendee")), "meeting_id").alias("_d"), "about_contract").join(domains, "_d", "left").join(people, "_d", "left")
    # Meetings of unknown accounts are spread, and match nothing.
    j = j.withColumn("_key", spread_nulls(F.col("_acct"), "meeting_id"))
    keyed = lambda df: df.withColumn("_key", F.col("_acct").cast("string")).drop("_acct")
    j = j.join(keyed(by_account), "_key", "left").join(keyed(terms), "_key", "left").na.fill(0, ["open_deals", "contracts", "leads"])
    on_contract = F.col("about_contract") & (F.col("contracts") == 1)
    on_deal = ~on_contract & (F.col("open_deals") == 1)
    bare = F.col("open_deals") + F.col("contracts") == 0
    on_customer = bare & F.coalesce("_customer", F.lit(False))
    on_lead = bare & ~on_customer & (F.col("leads") == 1)
    kind = F.when(on_contract, "renewal").when(on_deal, "opportunity").when(on_customer, "customer").when(on_lead, "lead")
    found = F.when(on_contract, F.col("_ren")).when(on_deal, F.col("_opp")).when(on_customer, F.col("_acct")).when(on_lead, F.col("_lead"))
    status = F.when(kind.isNotNull(), "linked").when(bare & (F.col("leads") == 0), "no match").otherwise("review")
    return j.select("meeting_id", status.alias("status"), kind.alias("related_type"), found.alias("related_id"), "open_deals", "contracts", "leads")


def meeting_credit(meetings: DataFrame, activity: DataFrame) -> DataFrame:
    """A meeting already on the calendar is not ingested again; one that left no other trace is."""
    known = activity.filter(F.col("kind") == "meeting").select("day", F.col("email").alias("attendee"), "opp_id", F.lit(True).alias("_known")).distinct()
    j = meetings.join(known, ["day", "attendee", "opp_id"], "left")
    return j.select("meeting_id", "day", "attendee", "opp_id", F.when(F.col("_known"), "already-on-calendar").otherwise("ingested").alias("engagement_ingested"))


def activity_union(mail: DataFrame, calendar: DataFrame, crm: DataFrame) -> DataFrame:
    """One set of events over all feeds; the same day, kind, counterpart and deal is one event."""
    key = ["day", "kind", "email", "opp_id"]
    return mail.unionByName(calendar).unionByName(crm).groupBy(*key).agg(F.min("activity_id").alias("activity_id"), F.count(F.lit(1)).alias("copies"))


def last_meeting(calendar: DataFrame, meetings: DataFrame) -> DataFrame:
    """The newest earlier meeting of the account, with its outcome and sentiment."""
    value = F.struct("day", "meeting_id", "outcome", "sentiment")
    out = asof_by_day(calendar, meetings, ["account"], "day", "day", value, "_last", strict=True)
    return out.select("meeting_id", "account", "day", F.col("_last.meeting_id").alias("last_meeting_id"), F.col("_last.day").alias("last_day"),
                      F.col("_last.outcome").alias("last_outcome"), F.col("_last.sentiment").alias("last_sentiment"))


def open_commitments(commitments: DataFrame, as_of: str) -> DataFrame:
    """Open promises of both sides per account, ours unmet first."""
    late = F.datediff(F.lit(as_of).cast("date"), F.col("due"))
    return commitments.filter(F.col("status") == "Open").select(
        "commitment_id", "account", "direction", "due", F.greatest(late, F.lit(0)).alias("days_late"),
        F.when((F.col("direction") == "ours") & (late > 0), 1).when(late > 0, 2).when(F.col("direction") == "ours", 3).otherwise(4).alias("rank"),
    ).orderBy("rank", F.col("days_late").desc(), "commitment_id")


def commitments_overdue(commitments: DataFrame, as_of: str) -> DataFrame:
    """Theirs overdue by account with the longest delay; ours overdue as a pattern per rep."""
    late = F.datediff(F.lit(as_of).cast("date"), F.col("due"))
    over = commitments.filter((F.col("status") == "Open") & (late > 0)).withColumn("_late", late)
    who = F.when(F.col("direction") == "theirs", F.col("account")).otherwise(F.col("owner"))
    return over.groupBy("direction", who.alias("who")).agg(F.count(F.lit(1)).alias("overdue"), F.max("_late").alias("worst_days"))


def new_attendees(calendar: DataFrame, contacts: DataFrame) -> DataFrame:
    """Attendees never seen on the deal of their account."""
    people = contacts.select(F.col("opp_id"), F.col("email").alias("attendee"))
    return calendar.filter(F.col("opp_id").isNotNull()).join(people, ["opp_id", "attendee"], "left_anti").select("meeting_id", "opp_id", "attendee")


def unowned_meetings(calendar: DataFrame, roster: DataFrame, absences: DataFrame) -> DataFrame:
    """Meetings with no owner, an owner off the roster, or an owner who is out that day."""
    reps = roster.select(F.col("rep").cast("long").alias("owner"), F.lit(True).alias("_rep"))
    out = absences.select("owner", "day", F.lit(True).alias("_out")).distinct()
    j = calendar.join(reps, "owner", "left").join(out, ["owner", "day"], "left")
    why = F.when(F.col("owner").isNull(), "no owner").when(F.col("_rep").isNull(), "not on the roster").when(F.col("_out"), "rep is out")
    return j.select("meeting_id", "day", "owner", why.alias("why")).filter(F.col("why").isNotNull())


def days_meetings(calendar: DataFrame, as_of: str) -> DataFrame:
    return calendar.filter(F.col("day") == F.lit(as_of).cast("date"))


def recent_news(signals: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Signals about an account in the last days: account, event_date, signal_id, signal_type."""
    day = F.lit(as_of).cast("date")
    recent = signals.filter(F.col("related_account").isNotNull() & F.col("event_date").between(F.date_sub(day, days), day))
    return recent.select(F.col("related_account").alias("account"), "event_date", "signal_id", "signal_type")


def meeting_news(today: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """The news behind the counts of `meeting_prep`, once for each account that meets today."""
    return recent_news(signals, as_of).join(today.select("account").distinct(), "account", "left_semi")


def meeting_prep(
    today: DataFrame, opps: DataFrame, gaps: DataFrame, trend: DataFrame, contacts: DataFrame, before: DataFrame, signals: DataFrame, commitments: DataFrame,
    mentions: DataFrame, cards: DataFrame, as_of: str,
) -> DataFrame:
    """Each of the day's meetings with what to know before it.

    Deal state, close-plan gaps and engagement trend; people and engaged people on the deal, and whether the attendee is new there; the account's last meeting
    with outcome and sentiment; open promises of both sides that are late; signals about the account in the last 30 days, their number and the newest (all of them are in
    `meeting_news`); changes since the battlecards of competitors the deal names. Sides fold to one row per deal or account before they join; all but
    `before` need hold no more than the day's deals and accounts.
    """
    day = F.lit(as_of).cast("date")
    deal = opps.select("opp_id", "stage", "amount", "close_date")
    people = contacts.groupBy("opp_id").agg(F.count(F.lit(1)).alias("people"), F.count_if("replied").alias("engaged"))
    known = contacts.select("opp_id", F.col("email").alias("attendee"), F.lit(True).alias("_known")).distinct()
    news = recent_news(signals, as_of).groupBy("account").agg(
        F.count(F.lit(1)).alias("news"), F.min_by("signal_id", F.struct((-F.unix_date("event_date")).alias("d"), F.col("signal_id"))).alias("latest_news"))
    owed = commitments.filter((F.col("status") == "Open") & (F.col("due") < day)).groupBy("account").agg(
        F.count_if(F.col("direction") == "ours").alias("we_owe"), F.count_if(F.col("direction") == "theirs").alias("they_owe"))
    stale = mentions.join(cards.select("competitor_id", "signals_since"), "competitor_id").groupBy("opp_id").agg(F.sum("signals_since").alias("card_changes"))
    j = today.join(deal, "opp_id", "left").join(gaps.select("opp_id", "close_plan_gaps"), "opp_id", "left").join(trend.select("opp_id", "trend"), "opp_id", "left")
    j = j.join(stale, "opp_id", "left").join(people, "opp_id", "left").join(known, ["opp_id", "attendee"], "left")
    j = j.join(last_meeting(today, before).drop("account", "day"), "meeting_id", "left").join(news, "account", "left").join(owed, "account", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(
        "meeting_id", "account", "opp_id", "stage", "amount", "close_date", F.coalesce("close_plan_gaps", F.array().cast("array<string>")).alias("close_plan_gaps"), "trend",
        count("people"), count("engaged"), (F.col("opp_id").isNotNull() & F.col("_known").isNull()).alias("first_time"),
        "last_meeting_id", "last_day", "last_outcome", "last_sentiment", count("we_owe"), count("they_owe"), count("card_changes"), count("news"), "latest_news")


def sentiment_trajectory(meetings: DataFrame, opps: DataFrame) -> DataFrame:
    """Each meeting with the two sentiments before it, and whether they slide while the stage looks healthy."""
    rank = F.create_map(*[F.lit(x) for pair in SENTIMENT_RANK.items() for x in pair])
    read = meetings.filter(F.col("sentiment") != "Unclear").withColumn("_rank", F.try_element_at(rank, "sentiment"))
    keys, order = ["account"], ["day", "meeting_id"]
    back = {"before_1": ("sentiment", 1), "_r1": ("_rank", 1), "before_2": ("sentiment", 2), "_r2": ("_rank", 2)}
    two = ordered_history(read, keys, order, F.col("day"), prev=back)
    stage = opps.select("opp_id", "stage")
    slide = (F.col("_rank") < F.col("_r1")) & (F.col("_r1") < F.col("_r2"))
    return two.join(stage, "opp_id", "left").select(
        "meeting_id", "account", "sentiment", "before_1", "before_2", "sentiment_evidence",
        F.coalesce(slide & F.col("stage").isin(*HEALTHY_STAGES), F.lit(False)).alias("sliding"))
