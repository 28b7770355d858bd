"""Campaign funnel, attribution, maturity, and the content gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import SAMPLE_FLOOR, guarded_rate, sample_note
from dealgrid.operators.forecast import MONEY, total
from dealgrid.operators.leads import contactable_gate

# Our defaults.
RESOLVED_SHARE = 0.6
WORKED_SHARE, CONTACTABLE_SHARE = 0.5, 0.6

# Days until a perishable item expires.
TTL_DAYS = {"Hours": 1, "Days": 7, "Weeks": 28}


def campaign_groups(campaigns: DataFrame) -> DataFrame:
    """One row per measurable group: campaigns that share a source value and no detail cannot be split.

    A campaign is split from its siblings when each of them names a source detail.
    """
    shared = campaigns.groupBy(F.col("source_value").alias("_sv")).agg(
        F.count(F.lit(1)).alias("_n"), F.count("detail").alias("_details"))
    j = campaigns.join(shared, F.col("source_value") == F.col("_sv"))
    split = (F.col("_n") > 1) & (F.col("_details") == F.col("_n"))
    key = F.when(split, F.col("detail"))
    return j.groupBy("source_value", key.alias("detail")).agg(
        F.min("campaign_id").alias("group_id"), F.count(F.lit(1)).alias("campaigns"), F.sum("cost").cast(MONEY).alias("cost"),
        F.min("started").alias("started"),
        F.max(F.when(split, "split by detail, approximate").when(F.col("_n") > 1, "reported together")).alias("split_note"),
    )


def attributed(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the campaign group their source (and detail, where the group is split) leads to."""
    g = groups.select(F.col("source_value").alias("_sv"), F.col("detail").alias("_d"), "group_id")
    match = (F.col("source") == F.col("_sv")) & (F.col("_d").isNull() | (F.col("_d") == F.col("source_detail")))
    return df.join(g, match).drop("_sv", "_d")


def campaign_attribution(campaigns: DataFrame, leads: DataFrame, opps: DataFrame, model: str = "recorded source") -> DataFrame:
    """Leads and deals of each campaign group, with the attribution model named on every row.

    The model says what the `source` of the records means, such as first touch, last touch or recorded source.
    """
    groups = campaign_groups(campaigns)
    l = attributed(leads, groups).select(F.lit("lead").alias("kind"), F.col("lead_id").alias("record_id"), "group_id")
    o = attributed(opps, groups).select(F.lit("deal").alias("kind"), F.col("opp_id").alias("record_id"), "group_id")
    return l.unionByName(o).withColumn("model", F.lit(model))


def campaign_funnel(campaigns: DataFrame, leads: DataFrame, opps: DataFrame) -> DataFrame:
    """The funnel per campaign group; each side is folded before the join, so nothing fans out."""
    groups = campaign_groups(campaigns)
    lead_side = attributed(contactable_gate(leads), groups).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("leads"), F.count_if("contactable").alias("leads_contactable"), F.count_if(F.col("status") != "New").alias("leads_worked"))
    won = F.col("stage") == "Closed Won"
    deal_side = attributed(opps, groups).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("opportunities"), F.count_if("is_open").alias("still_open"), F.count_if(won).alias("won"),
        total(F.col("converted_amount")).alias("pipeline"))
    j = groups.join(lead_side, "group_id", "left").join(deal_side, "group_id", "left")
    j = j.na.fill(0, ["leads", "leads_contactable", "leads_worked", "opportunities", "still_open", "won"])

    def per(n: str) -> Column:
        return F.try_divide(F.col("cost").cast("double"), F.col(n).cast("double"))

    return j.select(
        "group_id", "campaigns", "started", "cost", "split_note", "leads", "leads_contactable", "leads_worked", "opportunities", "still_open", "won",
        "pipeline", per("leads").alias("cost_per_lead"), per("opportunities").alias("cost_per_opp"),
        F.try_divide(F.col("pipeline").cast("double"), F.col("cost").cast("double")).alias("pipeline_roi"),
        guarded_rate(F.col("opportunities"), F.col("leads"), SAMPLE_FLOOR).alias("opp_rate"), sample_note(F.col("opportunities"), F.col("leads"), SAMPLE_FLOOR).alias("sample_note"),
    )


def campaign_maturity(funnel: DataFrame, cycle_days: int, as_of: str) -> DataFrame:
    """Whether enough of the cohort is resolved and old enough to conclude anything."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("started"))
    decided = F.col("opportunities") - F.col("still_open")
    share = F.try_divide(decided.cast("double"), F.col("opportunities").cast("double"))
    mature = (share >= RESOLVED_SHARE) & (age >= cycle_days)
    return funnel.select(
        "group_id", age.alias("age_days"), share.alias("resolved_share"),
        F.when(F.col("opportunities") == 0, "No pipeline").when(mature, "Mature").otherwise("Too early").alias("maturity"),
        F.when(mature, guarded_rate(F.col("won"), decided)).alias("win_rate"),
    )


def campaign_diagnosis(funnel: DataFrame) -> DataFrame:
    """Which part is at fault: the follow-up, the targeting or the channel."""
    worked = F.try_divide(F.col("leads_worked").cast("double"), F.col("leads").cast("double"))
    usable = F.try_divide(F.col("leads_contactable").cast("double"), F.col("leads").cast("double"))
    verdict = (
        F.when(F.col("leads") < SAMPLE_FLOOR, "too few leads").when(worked < WORKED_SHARE, "follow-up")
        .when(usable < CONTACTABLE_SHARE, "targeting").when(F.col("opportunities") == 0, "channel").otherwise("working")
    )
    return funnel.select("group_id", worked.alias("worked_share"), usable.alias("contactable_share"), verdict.alias("diagnosis"))


def attribution_overlap(credits: DataFrame, opps: DataFrame) -> DataFrame:
    """How far credited pipeline exceeds the actual, when several campaigns claim one deal."""
    amounts = opps.select(F.col("opp_id").alias("record_id"), "converted_amount")
    deals = credits.filter(F.col("kind") == "deal").groupBy("record_id").agg(F.count(F.lit(1)).alias("_claims")).join(amounts, "record_id")
    return deals.agg(
        F.sum("_claims").alias("credits"), F.count(F.lit(1)).alias("deals"),
        total(F.col("converted_amount") * F.col("_claims")).alias("credited"), total(F.col("converted_amount")).alias("actual"),
    ).withColumn("over", (F.col("credited") - F.col("actual")).cast(MONEY))


def rep_followup_quality(leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Share of each rep's campaign leads that got qualified."""
    l = attributed(leads, campaign_groups(campaigns))
    good = F.count_if(F.col("status") == "Qualified")
    return l.groupBy("group_id", "owner").agg(
        F.count(F.lit(1)).alias("leads"), good.alias("qualified"), guarded_rate(good, F.count(F.lit(1)), SAMPLE_FLOOR).alias("rate"))


def first_last_touch(touches: DataFrame, model: str) -> DataFrame:
    """Source of the first or the last touch of each deal; folds on the map side."""
    order = F.struct("day", "activity_id")
    if model == "first":
        pick = F.min_by(F.struct("event_type", "day"), order)
    elif model == "last":
        pick = F.max_by(F.struct("event_type", "day"), order)
    else:
        raise ValueError(f"unknown attribution model {model!r}")
    return touches.filter(F.col("opp_id").isNotNull()).groupBy("opp_id").agg(pick.alias("_t")).select(
        "opp_id", F.lit(model).alias("model"), F.col("_t.event_type").alias("source"), F.col("_t.day").alias("day"))


def perishability_expiry(content: DataFrame, as_of: str) -> DataFrame:
    """Unused perishable items become Expired once their time has passed; Evergreen stays."""
    ttl = F.create_map(*[F.lit(x) for pair in TTL_DAYS.items() for x in pair])
    last = F.date_add("logged", F.try_element_at(ttl, "perishability"))
    unused = F.col("status").isin("New", "Drafting", "In Review")
    gone = unused & (F.lit(as_of).cast("date") > last)
    return content.withColumn("expires", last).withColumn("status", F.when(F.coalesce(gone, F.lit(False)), "Expired").otherwise(F.col("status")))


def standing_gate(content: DataFrame, standing: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Content must cite a confirmed standing row and stay off the excluded topics."""
    ok = standing.filter("confirmed").select(F.col("standing_id").alias("standing_ref"), F.lit(True).alias("_ok"))
    out = content.join(ok, "standing_ref", "left").join(exclusions.select("topic", F.lit(True).alias("_no")), "topic", "left")
    verdict = F.when(F.col("_no"), "excluded topic").when(F.col("standing_ref").isNull(), "no standing").when(F.col("_ok"), "pass").otherwise("unconfirmed standing")
    return out.select("content_id", "topic", "standing_ref", verdict.alias("verdict"))


def campaign_content_link(content: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Published pieces and the campaign that promotes them, if any."""
    names = campaigns.select("campaign_id", "source_value")
    return content.filter(F.col("status") == "Published").join(names, "campaign_id", "left").select(
        "content_id", "campaign_id", "source_value", F.col("source_value").isNotNull().alias("measured"))


def drafts_in_review(content: DataFrame, tasks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Drafts that have waited a week or more, by kind."""
    day = F.lit(as_of).cast("date")
    c = content.filter(F.col("status").isin("Drafting", "In Review")).select(F.lit("content").alias("kind"), F.col("logged").alias("since"))
    k = tasks.filter(F.col("status") == "Awaiting Approval").select(F.lit("task").alias("kind"), F.col("raised").alias("since"))
    waiting = c.unionByName(k).filter(F.datediff(day, F.col("since")) >= days)
    return waiting.groupBy("kind").agg(F.count(F.lit(1)).alias("drafts"), F.max(F.datediff(day, F.col("since"))).alias("oldest_days"))
