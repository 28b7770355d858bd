"""Deal risk, hygiene and close-plan gaps; history counts; contacts and threading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import auto_reply_match, fiscal_quarter, flag_list
from dealgrid.operators.sequences import ordered_history

# Our defaults.
STALL_DAYS = 14
STAGE_OVERRUN = 1.5
MATERIAL_AMOUNT = 0.2
LATE_STAGES = ("Proposal", "Negotiate")
EARLY_STAGES = ("Qualify", "Discovery")

HISTORY_ORDER = ("day", "line", "part_no", "supp_no", "close_date", "amount")

# Risk flags, worst first.
RISK_ORDER = (
    "close-date-fictional", "close-date-slipping", "stalled-late", "stalled", "single-threaded", "no-reply-ever",
    "ghost-roles", "auto-reply-only", "no-next-step", "next-step-passed", "amount-moved",
)


def day_of(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def history_steps(history: DataFrame) -> DataFrame:
    """Each record of a deal next to the one before and the one after it; unused neighbours are pruned."""
    return ordered_history(
        history, ["opp_id"], list(HISTORY_ORDER), F.col("day"),
        prev={"_prev_close": "close_date", "_prev_stage": "stage", "_prev_amount": "amount"},
        following={"_next_day": "day", "_next_stage": "stage"},
    )


def _pushes() -> list[Column]:
    changed = F.when(F.col("close_date") != F.col("_prev_close"), F.struct(*HISTORY_ORDER))
    return [
        F.count_if(F.col("close_date") > F.col("_prev_close")).alias("close_date_pushes"),
        F.max_by("_prev_close", changed).alias("previous_close_date"),
    ]


def _stay(as_of: str) -> list[Column]:
    entered = F.when(F.col("_prev_stage").isNull() | (F.col("stage") != F.col("_prev_stage")), F.col("day"))
    return [
        F.max_by("stage", F.struct(*HISTORY_ORDER)).alias("stage"),
        F.datediff(day_of(as_of), F.max(entered)).alias("days_in_stage"),
    ]


def _moved_share() -> Column:
    return F.try_divide((F.col("amount") - F.col("_prev_amount")).cast("double"), F.col("_prev_amount").cast("double"))


def _moved(share: float) -> Column:
    return (F.col("stage") == F.col("_prev_stage")) & (F.abs(_moved_share()) >= share)


def close_date_pushes(seq: DataFrame) -> DataFrame:
    """Later moves of the close date per deal, and the date before the last change."""
    return seq.groupBy("opp_id").agg(*_pushes())


def history_facts(seq: DataFrame, as_of: str, share: float = MATERIAL_AMOUNT) -> DataFrame:
    """Everything a review needs from a deal's history, in one pass."""
    return seq.groupBy("opp_id").agg(*_pushes(), *_stay(as_of), F.bool_or(_moved(share)).alias("amount_moved"))


def flag_close_date_pushed(pushes: DataFrame) -> DataFrame:
    n = F.col("close_date_pushes")
    band = F.when(n >= 3, "re-baseline").when(n == 2, "pattern").when(n == 1, "normal").otherwise("none")
    return pushes.select("opp_id", "close_date_pushes", band.alias("push_band"))


def days_in_stage(seq: DataFrame, as_of: str) -> DataFrame:
    """Days since the last change of stage (or since the first record)."""
    return seq.groupBy("opp_id").agg(*_stay(as_of))


def stage_medians(spans: DataFrame) -> DataFrame:
    """Median days per stage; exact, as its state is one count per distinct number of days."""
    return spans.groupBy("stage").agg(F.percentile("days_in_stage", 0.5).alias("median_days"), F.count(F.lit(1)).alias("deals"))


def stage_spans(seq: DataFrame) -> DataFrame:
    """Days each finished stay in a stage took."""
    return seq.filter(F.col("_next_day").isNotNull() & (F.col("stage") != F.col("_next_stage"))).select(
        "opp_id", "stage", F.datediff("_next_day", "day").alias("days_in_stage")
    )


def people_fold(activity: DataFrame) -> DataFrame:
    """One row per deal and person: whether they replied, the traffic with them, and its last day. All that flags need of the activity."""
    inbound = F.col("direction") == "inbound"
    machine = auto_reply_match(F.col("subject"))
    return activity.filter(F.col("opp_id").isNotNull()).groupBy("opp_id", "email").agg(
        _replied().alias("replied"), F.max("day").alias("last_day"), F.count_if(F.col("direction") == "outbound").alias("outbound"), F.count_if(inbound).alias("inbound"),
        F.count_if(inbound & machine).alias("machine_inbound"), F.count("direction").alias("directed"))


def last_activity(activity: DataFrame) -> DataFrame:
    return activity.filter(F.col("opp_id").isNotNull()).groupBy("opp_id").agg(F.max("day").alias("last_day"))


def flag_stalled(opps: DataFrame, last_days: DataFrame, in_stage: DataFrame, medians: DataFrame, as_of: str) -> DataFrame:
    """Open deals with no activity for two weeks, or far past the median of their stage.

    A deal with no activity at all (no row in `last_days`) is not judged by activity: it is untracked, not quiet. There are as many medians as stages, so deals
    look theirs up and aren't dealt out by stage.
    """
    by_stage = medians.filter(F.col("stage").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct("stage", "median_days"))).alias("m")).scalar()
    out = (
        opps.filter("is_open").select("opp_id", "stage")
        .join(last_days, "opp_id", "left")
        .join(in_stage.select("opp_id", "days_in_stage"), "opp_id", "left")
        .withColumn("median_days", F.try_element_at(by_stage, F.col("stage")))
    )
    quiet = F.datediff(day_of(as_of), F.col("last_day"))
    long_stay = F.col("days_in_stage") > F.col("median_days") * STAGE_OVERRUN
    stalled = F.coalesce(quiet >= STALL_DAYS, F.lit(False)) | F.coalesce(long_stay, F.lit(False))
    return out.select(
        "opp_id", "stage", quiet.alias("quiet_days"), stalled.alias("stalled"),
        (stalled & F.col("stage").isin(*LATE_STAGES)).alias("late_stage"),
    )


def stage_stall(flags: DataFrame) -> DataFrame:
    return flags.groupBy("stage").agg(
        F.count(F.lit(1)).alias("open_deals"), F.count_if("stalled").alias("stalled_deals"),
        F.try_divide(F.count_if("stalled").cast("double"), F.count(F.lit(1)).cast("double")).alias("stalled_share"),
    )


def next_step_cause(as_of: str, start_month: int = 1) -> Column:
    quarter = fiscal_quarter(day_of(as_of), start_month)
    inside = F.col("is_open") & F.col("close_date").between(quarter["start"], quarter["end"])
    return (
        F.when(inside & F.col("next_step").isNull(), "no-next-step")
        .when(inside & (F.col("next_step_date") < day_of(as_of)), "next-step-passed")
    )


def flag_next_step(opps: DataFrame, as_of: str, start_month: int = 1) -> DataFrame:
    """Deals that close inside this quarter without a next step, or with one whose date has passed."""
    return opps.select("opp_id", next_step_cause(as_of, start_month).alias("cause")).filter(F.col("cause").isNotNull())


def flag_amount_moved(seq: DataFrame, share: float = MATERIAL_AMOUNT) -> DataFrame:
    """Changes of the amount beyond a share while the stage stayed."""
    return seq.filter(_moved(share)).select(
        "opp_id", "day", "stage", F.col("_prev_amount").alias("amount_before"), "amount", _moved_share().alias("moved_share"))


def hygiene_flags(opps: DataFrame, as_of: str) -> DataFrame:
    """Data faults, kept apart from risk."""
    return opps.select("opp_id", flag_list(
        (F.col("is_open") & (F.col("close_date") < day_of(as_of)), "close-date-passed"),
        (F.col("owner").isNull(), "no-owner"),
    ).alias("hygiene_flags")).filter(F.size("hygiene_flags") > 0)


def close_plan_gaps(opps: DataFrame, stage_order: Sequence[str]) -> DataFrame:
    """Close-plan items missing at a stage where they should be there."""
    rank = F.array_position(F.array(*[F.lit(s) for s in stage_order]), F.col("stage"))

    def from_stage(stage: str) -> Column:
        return rank >= list(stage_order).index(stage) + 1

    return opps.filter("is_open").select("opp_id", "stage", flag_list(
        (F.col("champion").isNull() & from_stage("Discovery"), "champion"),
        (F.col("economic_buyer").isNull() & from_stage("Validate"), "economic buyer"),
        (F.col("paper_process").isNull() & from_stage("Proposal"), "paper process"),
    ).alias("close_plan_gaps"))


def reply_evidence(activity: DataFrame) -> DataFrame:
    """Whether each person ever replied: yes, no, or null when no direction was logged for them."""
    return _with_evidence(activity.filter(F.col("opp_id").isNotNull()).groupBy("opp_id", "email").agg(_replied().alias("replied")))


def _replied() -> Column:
    genuine = ~auto_reply_match(F.col("subject"))
    return F.bool_or(F.when(F.col("direction").isNotNull(), F.col("direction").isin("inbound", "both") & genuine))


def _with_evidence(people: DataFrame) -> DataFrame:
    return people.select("opp_id", "email", "replied", F.when(F.col("replied").isNull(), "none").otherwise("logged direction").alias("reply_evidence"))


def meeting_evidence(activity: DataFrame, meetings: DataFrame) -> DataFrame:
    """The strongest proof of a meeting per deal and person: transcript, linked event, accepted invite."""
    rungs = F.when(F.col("feed") == "crm", 2).when(F.col("feed") == "calendar", 1)
    logged = (
        activity.filter((F.col("kind") == "meeting") & F.col("opp_id").isNotNull())
        .select("opp_id", "email", rungs.alias("rung"))
    )
    held = meetings.filter(F.col("opp_id").isNotNull()).select("opp_id", F.col("attendee").alias("email"), F.lit(3).alias("rung"))
    best = logged.unionByName(held).groupBy("opp_id", "email").agg(F.max("rung").alias("rung"))
    names = F.create_map(F.lit(3), F.lit("transcript"), F.lit(2), F.lit("opportunity-linked"), F.lit(1), F.lit("invite-accepted"))
    return best.select("opp_id", "email", F.coalesce(F.try_element_at(names, "rung"), F.lit("none")).alias("meeting_evidence"))


def activity_noise_filter(activity: DataFrame, since: str, patterns: Sequence[str]) -> DataFrame:
    """Bound by date and drop machine-made entries; an entry without a subject stays."""
    noise = F.coalesce(auto_reply_match(F.col("subject"), patterns), F.lit(False))
    return activity.filter((F.col("day") >= day_of(since)) & ~noise)


def untracked_deals(opps: DataFrame, activity: DataFrame) -> DataFrame:
    """Open deals with no activity at all: nothing is known about them."""
    seen = activity.filter(F.col("opp_id").isNotNull()).select("opp_id")
    return opps.filter("is_open").join(seen, "opp_id", "left_anti").select("opp_id", "account", "stage")


def contacts_build(roles: DataFrame, activity: DataFrame) -> DataFrame:
    """One row per person per deal, saying which side each came from."""
    return contacts_of(roles, reply_evidence(activity))


def contacts_of(roles: DataFrame, people: DataFrame) -> DataFrame:
    """`contacts_build` from people already folded to one row per deal and person."""
    listed = roles.select("opp_id", "email", F.lit(True).alias("_role"))
    seen = _with_evidence(people).withColumn("_seen", F.lit(True))
    both = listed.join(seen, ["opp_id", "email"], "full")
    source = F.when(F.col("_role") & F.col("_seen"), "both").when(F.col("_role"), "role-only").otherwise("activity-only")
    return both.select(
        "opp_id", "email", source.alias("source"), "replied", F.coalesce("reply_evidence", F.lit("none")).alias("reply_evidence")
    )


def contacts_rollup(contacts: DataFrame) -> DataFrame:
    """Attached is everyone, engaged is everyone who replied."""
    return contacts.groupBy("opp_id").agg(
        F.count(F.lit(1)).alias("contacts_attached"), F.count_if(F.col("replied")).alias("contacts_engaged"),
        F.count_if(F.col("replied").isNull()).alias("undetermined"),
    )


def contacts_fold(contacts: DataFrame, meetings: DataFrame) -> DataFrame:
    """Add meeting columns from attendance; people seen only in a meeting get rows with blank e-mail columns."""
    held = meetings.filter(F.col("opp_id").isNotNull()).groupBy("opp_id", F.col("attendee").alias("email")).agg(
        F.count(F.lit(1)).alias("meetings_attended"), F.max("day").alias("last_meeting")
    )
    both = contacts.join(held, ["opp_id", "email"], "full")
    return both.select(
        "opp_id", "email", F.coalesce("source", F.lit("activity-only")).alias("source"), "replied",
        F.coalesce("meetings_attended", F.lit(0)).alias("meetings_attended"), "last_meeting",
        F.when(F.col("meetings_attended") > 0, "transcript").alias("meeting_evidence"),
    )


def ghost_roles(roles: DataFrame, activity: DataFrame) -> DataFrame:
    """Deals with contact roles of which none shows in the activity of the deal."""
    active = activity.filter(F.col("opp_id").isNotNull()).select("opp_id", "email")
    known = roles.select("opp_id").distinct()
    alive = roles.join(active, ["opp_id", "email"], "left_semi").select("opp_id").distinct()
    return known.join(alive, "opp_id", "left_anti")


def threading_flags(contacts: DataFrame, seen: DataFrame, opps: DataFrame) -> DataFrame:
    """single-threaded, no-reply-ever and auto-reply-only for each open deal, with the counts behind them, from `people_fold`.

    Without any logged direction the state is unknown, never good or bad news.
    """
    people = contacts.groupBy("opp_id").agg(
        F.count(F.lit(1)).alias("people"), F.count_if(F.col("replied")).alias("repliers")
    )
    traffic = seen.groupBy("opp_id").agg(*[F.sum(c).alias(c) for c in ("outbound", "inbound", "machine_inbound", "directed")])
    j = (
        opps.filter("is_open").select("opp_id", "stage").join(people, "opp_id", "left").join(traffic, "opp_id", "left")
    )
    known = F.coalesce(F.col("directed"), F.lit(0)) > 0
    state = (
        F.when(F.col("people").isNull(), "no contacts loaded").when(~known, "unknown").otherwise("known")
    )
    flags = flag_list(
        (known & (F.col("repliers") == 1) & ~F.col("stage").isin(*EARLY_STAGES), "single-threaded"),
        (known & (F.col("repliers") == 0) & (F.col("outbound") > 0), "no-reply-ever"),
        (known & (F.col("inbound") > 0) & (F.col("inbound") == F.col("machine_inbound")), "auto-reply-only"),
    )
    return j.select("opp_id", state.alias("state"), flags.alias("flags"), "people", "repliers", "outbound", "inbound")


def risk_flags(
    opps: DataFrame, facts: DataFrame, stalls: DataFrame, threading: DataFrame, ghosts: DataFrame, as_of: str
) -> DataFrame:
    """The whole ordered flag list of each open deal, worst first, with the number of flags.

    Every input holds one row per deal, so the joins keep one partitioning.
    """
    j = (
        opps.filter("is_open").withColumn("_step", next_step_cause(as_of)).select("opp_id", "stage", "_step")
        .join(facts.select("opp_id", "close_date_pushes", "amount_moved"), "opp_id", "left")
        .join(stalls.select("opp_id", "stalled", "late_stage"), "opp_id", "left")
        .join(threading.select("opp_id", "flags"), "opp_id", "left")
        .join(ghosts.withColumn("_ghost", F.lit(True)), "opp_id", "left")
    )
    threads = F.coalesce(F.col("flags"), F.array().cast("array<string>"))
    held = {
        "close-date-fictional": F.col("close_date_pushes") >= 3,
        "close-date-slipping": F.col("close_date_pushes") == 2,
        "stalled-late": F.col("late_stage"),
        "stalled": F.col("stalled") & ~F.col("late_stage"),
        "single-threaded": F.array_contains(threads, "single-threaded"),
        "no-reply-ever": F.array_contains(threads, "no-reply-ever"),
        "ghost-roles": F.col("_ghost"),
        "auto-reply-only": F.array_contains(threads, "auto-reply-only"),
        "no-next-step": F.col("_step") == "no-next-step",
        "next-step-passed": F.col("_step") == "next-step-passed",
        "amount-moved": F.col("amount_moved"),
    }
    flags = flag_list(*[(held[name], name) for name in RISK_ORDER])
    return j.select("opp_id", "stage", flags.alias("risk_flags"), F.size(flags).alias("severity"))


def risk_review(risks: DataFrame, movement: DataFrame, opps: DataFrame) -> DataFrame:
    """Review order: what moved, what is at risk, and deals that call for a decision."""
    moved = movement.filter(~F.col("movement").isin("unchanged", "dropped")).select(
        F.lit(1).alias("section_no"), F.lit("moved").alias("section"), "opp_id", F.col("movement").alias("detail"), F.lit(0).alias("severity")
    )
    flagged = risks.filter(F.col("severity") > 0)
    dead = F.array_contains("risk_flags", "close-date-fictional") & F.arrays_overlap(
        "risk_flags", F.array(F.lit("stalled"), F.lit("stalled-late"))
    )
    rows = flagged.select(
        F.when(dead, 3).otherwise(2).alias("section_no"), F.when(dead, "decide").otherwise("at risk").alias("section"),
        "opp_id", F.concat_ws(",", "risk_flags").alias("detail"), "severity",
    )
    owners = opps.select("opp_id", "owner")
    return moved.unionByName(rows).join(owners, "opp_id").orderBy("section_no", F.col("severity").desc(), "opp_id")


def won_without_customer(opps: DataFrame, customers: DataFrame) -> DataFrame:
    won = opps.filter(F.col("stage") == "Closed Won").select("opp_id", "account")
    return won.join(customers.select("account"), "account", "left_anti")


def loss_clusters(opps: DataFrame, accounts: DataFrame) -> DataFrame:
    """Losses by reason, source and segment, each alone and in pairs."""
    lost = opps.filter(F.col("stage") == "Closed Lost").join(accounts.select("account", "segment"), "account", "left")
    lost = lost.select(
        "loss_reason", F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"), "segment", "amount"
    )
    r, s, g = F.col("loss_reason"), F.col("source"), F.col("segment")
    return lost.groupingSets([[r], [s], [g], [r, s], [r, g], [s, g]], r, s, g).agg(
        F.count(F.lit(1)).alias("losses"), F.sum("amount").cast("decimal(18,2)").alias("lost_amount")
    ).select("loss_reason", "source", "segment", "losses", "lost_amount")


def evidence_struct(activity: DataFrame, since: str, until: str) -> DataFrame:
    """The events behind a deal's flags as one sorted list of day, kind and count.

    Events fold to one entry per day and kind first, so the list is bounded by the days of the window.
    """
    daily = (
        activity.filter(F.col("opp_id").isNotNull() & F.col("day").between(day_of(since), day_of(until)))
        .groupBy("opp_id", "day", "kind").agg(F.count(F.lit(1)).alias("n"))
    )
    return daily.groupBy("opp_id").agg(
        F.array_sort(F.collect_list(F.struct("day", "kind", "n"))).alias("evidence")
    )
