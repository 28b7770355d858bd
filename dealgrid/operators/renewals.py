"""Renewals: deadlines, risk, links to deals, coverage and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import flag_list
from dealgrid.operators.forecast import MONEY, in_period, total
from dealgrid.operators.sequences import asof_by_day

QUIET_DAYS = 60
QBR_MONTHS = 6
SOON_DAYS = 30
NOTICE_SOON_DAYS = 30
AT_RISK_FLAGS = ("no-renewal-opp", "conversation-overdue", "champion-left", "contraction-risk")


def renewal_deadlines(renewals: DataFrame, as_of: str) -> DataFrame:
    """Conversation target and notice deadline, with days to each; no notice period means no deadline."""
    day = F.lit(as_of).cast("date")
    return (
        renewals.withColumn("conversation_target_date", F.date_sub("contract_end", F.col("lead_days")))
        .withColumn("notice_deadline", F.date_sub("contract_end", F.col("notice_days")))
        .withColumn("days_to_expiry", F.datediff("contract_end", day))
        .withColumn("days_to_conversation_target", F.datediff("conversation_target_date", day))
        .withColumn("days_to_notice", F.datediff("notice_deadline", day))
    )


def idle_outcome(renewals: DataFrame, default_auto_renew: bool) -> DataFrame:
    """What happens if nobody acts; the contract's own term wins over the org's default."""
    renews = F.coalesce("auto_renew", F.lit(default_auto_renew))
    return renewals.withColumn("idle_outcome", F.when(renews, "auto-renews").otherwise("lapses"))


def renewal_outcome(renewals: DataFrame) -> DataFrame:
    """Outcome at close; the source system's own answer wins."""
    cur, new = F.col("current_value"), F.col("proposed_value")
    computed = (
        F.when(F.col("status") == "Churned", "churned").when(new > cur, "expanded").when(new < cur, "contracted").when(new == cur, "flat")
    )
    closed = F.col("status") != "Active"
    return renewals.filter(closed).withColumn("outcome", F.coalesce("crm_outcome", computed))


def link_contracts(won: DataFrame, renewals: DataFrame, as_of: str) -> DataFrame:
    """Contracts of won deals that still run, matched on the original deal, else account and end date."""
    running = won.filter((F.col("stage") == "Closed Won") & (F.date_add("close_date", 365) > F.lit(as_of).cast("date"))).select(
        "opp_id", "account", F.date_add("close_date", 365).alias("contract_end")
    )
    by_deal = renewals.filter(F.col("original_opp_id").isNotNull()).groupBy(F.col("original_opp_id").alias("opp_id")).agg(
        F.min("renewal_id").alias("_deal_match"))
    by_term = renewals.groupBy("account", "contract_end").agg(F.min("renewal_id").alias("_term_match"))
    out = running.join(by_deal, "opp_id", "left").join(by_term, ["account", "contract_end"], "left")
    basis = F.when(F.col("_deal_match").isNotNull(), "deal").when(F.col("_term_match").isNotNull(), "account and end").otherwise("new")
    return out.select("opp_id", "account", "contract_end", basis.alias("basis"), F.coalesce("_deal_match", "_term_match").alias("renewal_id"))


def link_renewal_opp(contracts: DataFrame, opps: DataFrame) -> DataFrame:
    """The earliest marked renewal deal of the account created after the contract began."""
    marked = opps.filter(F.col("track") == "renewal").select("account", "created", "opp_id", "stage", "is_open")
    value = F.struct("created", "opp_id", "stage", "is_open")
    linked = asof_by_day(contracts, marked, ["account"], "contract_start", "created", value, "_deal", strict=True, forward=True)
    return linked.withColumn("renewal_opp_id", F.col("_deal.opp_id")).withColumn("renewal_opp_stage", F.col("_deal.stage")).withColumn(
        "renewal_opp_created", F.col("_deal.created")).withColumn("renewal_opp_open", F.col("_deal.is_open")).drop("_deal")


def uncovered_contracts(linked: DataFrame, policy: str, as_of: str, window_days: int = 180) -> DataFrame:
    """Running contracts without a renewal deal: from day one under an at-close policy, else inside the window."""
    day = F.lit(as_of).cast("date")
    bare = linked.filter((F.col("status") == "Active") & F.col("renewal_opp_id").isNull())
    if policy == "at-close":
        return bare
    return bare.filter(F.datediff("contract_end", day) <= window_days)


def propose_renewal_opps(uncovered: DataFrame) -> DataFrame:
    """Rows to review before a renewal deal is opened."""
    return uncovered.select(
        "renewal_id", "account", "owner", F.col("current_value").alias("amount"), "currency",
        F.date_add("contract_end", 1).alias("new_start"), F.col("contract_end").alias("close_date"),
        F.lit("renewal").alias("track"), F.lit("Qualify").alias("stage"),
    )


# Wording of a subject that is plainly about the renewal.
RENEWAL_WORDS = r"renew|extension|next term|contract end|new term"


def first_renewal_touch(contracts: DataFrame, activity: DataFrame, about: str = RENEWAL_WORDS) -> DataFrame:
    """First sent mail or held meeting about the renewal with the account after the contract began.

    The subject has to say so (`about`); a touch that is not plainly about it leaves the date blank.
    """
    counts = ((F.col("kind") == "meeting") | (F.col("direction") == "outbound")) & F.lower("subject").rlike(about)
    real = activity.filter(counts).select("account", "day")
    out = asof_by_day(contracts, real, ["account"], "contract_start", "day", F.col("day"), "first_renewal_touch_date", strict=True, forward=True)
    return out.select("renewal_id", "account", "contract_start", "first_renewal_touch_date")


def renewal_risk_flags(renewals: DataFrame, linked: DataFrame, activity: DataFrame, as_of: str, worth: Column | None = None) -> DataFrame:
    """Flags of each running contract, worst first, with the days a missed conversation is late."""
    day = F.lit(as_of).cast("date")
    quiet = activity.groupBy("account").agg(F.max("day").alias("_last_day"))
    links = linked.select("renewal_id", "renewal_opp_id", "renewal_opp_open")
    j = (
        renewal_deadlines(renewals, as_of).filter(F.col("status") == "Active")
        .join(links, "renewal_id", "left").join(quiet, "account", "left")
    )
    worth = F.lit(True) if worth is None else worth
    waiting = F.col("first_touch").isNull()
    target = F.col("days_to_conversation_target")
    flags = flag_list(
        (F.col("renewal_opp_id").isNull(), "no-renewal-opp"),
        (waiting & (target < 0), "conversation-overdue"),
        (waiting & target.between(0, SOON_DAYS), "conversation-due-soon"),
        (F.col("days_to_notice").between(0, NOTICE_SOON_DAYS), "notice-window-closing"),
        (~F.col("champion_still_there"), "champion-left"),
        (worth & (F.col("last_qbr").isNull() | (F.col("last_qbr") < F.add_months(day, -QBR_MONTHS))), "no-qbr"),
        (F.datediff(day, F.col("_last_day")) >= QUIET_DAYS, "quiet"),
        (F.col("renewal_opp_open") & (F.col("proposed_value") < F.col("current_value")), "contraction-risk"),
    )
    late = F.when(waiting & (target < 0), -target)
    return j.select("renewal_id", "account", "owner", "current_value", flags.alias("risk_flags"), late.alias("days_overdue"), "expansion_signal")


def renewal_ranking(flagged: DataFrame) -> DataFrame:
    """Sections by the decision needed, inside them by exposure (value times number of flags), not by date."""
    f = F.col("risk_flags")
    section = (
        F.when(F.array_contains(f, "conversation-overdue") | F.array_contains(f, "no-renewal-opp"), "commitment missed")
        .when(F.array_contains(f, "conversation-due-soon"), "due soon").when(F.size(f) > 0, "at risk")
        .when(F.col("expansion_signal").isNotNull(), "expansion").otherwise("covered")
    )
    order = F.create_map(*[F.lit(x) for i, s in enumerate(("commitment missed", "due soon", "at risk", "expansion", "covered")) for x in (s, i)])
    exposure = (F.col("current_value") * F.size(f)).cast(MONEY)
    return (
        flagged.select("renewal_id", section.alias("section"), exposure.alias("exposure"))
        .withColumn("section_no", F.try_element_at(order, "section"))
        .orderBy("section_no", F.col("exposure").desc(), "renewal_id")
    )


def expansion_already_open(renewals: DataFrame, opps: DataFrame) -> DataFrame:
    """Contracts whose account already has another new-business motion open."""
    moving = opps.filter(F.col("is_open") & (F.col("track") == "new")).select("account")
    return renewals.select("renewal_id", "account").join(moving, "account", "left_semi")


def renewal_coverage(renewals: DataFrame, linked: DataFrame, start: str, end: str) -> DataFrame:
    """Due, secured, at risk and lost by quarter, measured against 100 percent; and value without a deal."""
    state = renewals.join(linked.select("renewal_id", "renewal_opp_id"), "renewal_id", "left").filter(in_period("contract_end", start, end))
    value = F.col("converted_current_value")
    secured = F.col("status").isin("Renewed", "Auto-Renewed", "Downgraded")
    sums = state.groupBy(F.date_trunc("quarter", "contract_end").cast("date").alias("quarter")).agg(
        total(value).alias("due"),
        total(F.when(F.col("status") == "Downgraded", F.least("converted_proposed_value", value)).otherwise(value), secured).alias("secured"),
        total(value, F.col("status") == "Churned").alias("lost"),
        total(value, (F.col("status") == "Active") & ~F.col("champion_still_there")).alias("at_risk"),
        total(value, (F.col("status") == "Active") & F.col("renewal_opp_id").isNull()).alias("no_deal"),
        F.count_if(value.isNull()).alias("unconverted"),
    )
    return sums.withColumn("coverage", F.try_divide(F.col("secured").cast("double"), F.col("due").cast("double")))


def renewal_movement(cur: DataFrame, prior: DataFrame, start: str, end: str) -> DataFrame:
    """Contracts newly resolved since the prior look and what each did to the coverage of the period."""
    value = F.col("converted_current_value")
    due = cur.filter(in_period("contract_end", start, end)).agg(total(value).alias("due")).scalar()
    before = prior.select("renewal_id", F.col("status").alias("status_before"))
    settled = (
        cur.filter(in_period("contract_end", start, end) & (F.col("status") != "Active")).join(before, "renewal_id")
        .filter(F.col("status_before") == "Active")
    )
    gain = F.when(F.col("status") == "Churned", F.lit(0).cast(MONEY)).otherwise(value)
    return settled.select(
        "renewal_id", "status", value.alias("value"),
        F.try_divide(gain.cast("double"), due.cast("double")).alias("coverage_change"),
    )


def policy_lag(linked: DataFrame) -> DataFrame:
    """Days between contract start and the renewal deal, as one finding."""
    lag = F.datediff("renewal_opp_created", "contract_start")
    return linked.filter(F.col("renewal_opp_id").isNotNull()).agg(
        F.percentile(lag, 0.5).alias("median_lag_days"), F.count(F.lit(1)).alias("contracts")
    )


def late_touch_on_churn(renewals: DataFrame) -> DataFrame:
    """Lost contracts whose first conversation was missing or late."""
    target = F.date_sub("contract_end", F.col("lead_days"))
    return renewals.filter(F.col("status") == "Churned").agg(
        F.count(F.lit(1)).alias("churned"), F.count_if(F.col("first_touch").isNull()).alias("never_touched"),
        F.count_if(F.col("first_touch") > target).alias("touched_late"),
    )


def churn_clusters(renewals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Churn by segment, product, cohort and motion, each alone and in pairs."""
    lost = renewals.filter(F.col("status") == "Churned").join(
        accounts.select("account", "segment", F.col("interest").alias("product")), "account", "left")
    lost = lost.select("segment", "product", F.year("contract_start").cast("string").alias("cohort"),
                       F.when(F.coalesce("auto_renew", F.lit(False)), "auto").otherwise("signed").alias("motion"), "current_value")
    dims = [F.col(c) for c in ("segment", "product", "cohort", "motion")]
    sets = [[d] for d in dims] + [[a, b] for i, a in enumerate(dims) for b in dims[i + 1:]]
    return lost.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("churned"), F.sum("current_value").cast(MONEY).alias("lost_value")
    ).select("segment", "product", "cohort", "motion", "churned", "lost_value")


def renewal_owner_load(renewals: DataFrame, activity: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Running book per rep, and whether the rep logged anything lately."""
    book = renewals.filter(F.col("status") == "Active").groupBy("owner").agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("current_value").cast(MONEY).alias("book"))
    busy = activity.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days)).groupBy(
        F.col("actor").alias("owner")).agg(F.count(F.lit(1)).alias("events"))
    return book.join(busy, "owner", "left").select("owner", "contracts", "book", F.coalesce("events", F.lit(0)).alias("events"), F.col("events").isNull().alias("no_activity"))
