"""Leads: contact gates, triage, matching, duplicates, conversion and shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import flag_list, norm_company
from dealgrid.operators.sequences import spread_nulls

# What each blocking field closes, and whether it redirects instead.
CONTACTABILITY = {
    "marketing_opt_out": ("marketing", None),
    "direct_opt_out": ("direct", None),
    "bounced": ("email", "find a new address"),
    "left_company": ("all", "find the successor"),
}
BLOCKING = ("direct", "email", "all")


def contactable_gate(leads: DataFrame, rules: Mapping[str, tuple[str, str | None]] = CONTACTABILITY) -> DataFrame:
    """contactable, the fields and channels that closed it, and the redirect to raise instead.

    A marketing opt-out closes that channel only; a blank field closes nothing.
    """
    held = {name: F.coalesce(F.col(name), F.lit(False)) for name in rules}
    fields = flag_list(*[(cond, name) for name, cond in held.items()])
    channels = flag_list(*[(cond, rules[name][0]) for name, cond in held.items()])
    stop = [cond for name, cond in held.items() if rules[name][0] in BLOCKING]
    blocked = stop[0]
    for cond in stop[1:]:
        blocked = blocked | cond
    redirects = [F.when(held[name], F.lit(rule[1])) for name, rule in rules.items() if rule[1]]
    return (
        leads.withColumn("contactable", ~blocked).withColumn("contact_restrictions", fields)
        .withColumn("closed_channels", channels).withColumn("next_action", F.coalesce(*redirects))
    )


def sequence_gate(leads: DataFrame, as_of: str) -> DataFrame:
    """suppressed while a cadence has a step to come; a reply lifts it and comes first."""
    replied = F.coalesce(F.col("replied_to_sequence"), F.lit(False))
    running = F.coalesce(F.col("in_sequence") & (F.col("sequence_next") > F.lit(as_of).cast("date")), F.lit(False))
    return leads.withColumn("suppressed", running & ~replied).withColumn("replied_first", replied)


def outreach_eligible(leads: DataFrame, as_of: str) -> DataFrame:
    return sequence_gate(contactable_gate(leads), as_of).filter(F.col("contactable") & ~F.col("suppressed"))


def triage_tier(as_of: str, inbound_sources: Sequence[int]) -> Column:
    day = F.lit(as_of).cast("date")
    quiet = F.datediff(day, F.col("last_activity"))
    inbound = F.datediff(day, F.col("last_inbound"))
    return (
        F.when(F.col("replied_first"), 1)
        .when(F.col("source").isin(*inbound_sources) & (inbound <= 7), 2)
        .when((F.col("status") == "Working") & quiet.between(5, 21) & ~F.coalesce(F.col("in_sequence"), F.lit(False)), 3)
        .when((F.col("status") == "New") & F.col("last_activity").isNull() & (F.datediff(day, F.col("created")) >= 2), 4)
        .otherwise(5)
    )


def lead_triage(leads: DataFrame, as_of: str, inbound_sources: Sequence[int], k: int = 10) -> DataFrame:
    """At most `k` leads with a reason each, best tier and longest wait first; the rest as one count row."""
    day = F.lit(as_of).cast("date")
    ranked = (
        outreach_eligible(leads, as_of).withColumn("tier", triage_tier(as_of, inbound_sources))
        .withColumn("wait_days", F.datediff(day, F.coalesce("last_activity", "created")))
    )
    names = F.create_map(
        F.lit(1), F.lit("answered the sequence"), F.lit(2), F.lit("recent inbound"), F.lit(3), F.lit("going cold"), F.lit(4), F.lit("never touched")
    )
    reason = F.concat_ws(" ", F.col("name"), F.lit("-"), F.try_element_at(names, "tier"), F.col("wait_days"), F.lit("days"))
    top = (
        ranked.filter(F.col("tier") < 5).orderBy("tier", F.col("wait_days").desc(), "lead_id").limit(k)
        .select("tier", "lead_id", reason.alias("reason"), F.lit(1).cast("long").alias("leads"))
    )
    rest = ranked.filter(F.col("tier") == 5).agg(F.count(F.lit(1)).alias("leads")).select(
        F.lit(5).alias("tier"), F.lit(None).cast("long").alias("lead_id"), F.lit("everything else").alias("reason"), "leads"
    )
    return top.unionByName(rest)


def person_key() -> Column:
    """Name and company as one key; null unless both are given."""
    name, company = F.lower(F.trim("name")), norm_company(F.col("company"))
    return F.when((name != "") & company.isNotNull(), F.concat(name, F.lit("|"), company))


def match_leads(incoming: DataFrame, leads: DataFrame) -> DataFrame:
    """Match on source id, else e-mail, else name with company, both given; only the id is certain.

    Candidates fold to one row per key (lowest id and how many share it), so a common key adds no
    rows. One left join per tier; the first tier that hits decides, and `match_key` is the key under which
    `match_candidates` lists all candidates.
    """
    def folded(key: Column, name: str) -> DataFrame:
        keyed = leads.select(key.alias(f"_{name}"), "lead_id").filter(F.col(f"_{name}").isNotNull())
        return keyed.groupBy(f"_{name}").agg(F.min("lead_id").alias(f"{name}_lead"), F.count(F.lit(1)).alias(f"{name}_n"))

    person = person_key()
    out = incoming.withColumn("_person_key", person).withColumn("_mail_key", F.lower("email"))
    crm, mail, named = folded(F.col("crm_id"), "crm"), folded(F.lower("email"), "mail"), folded(person, "person")
    for col in ("crm_id", "_mail_key", "_person_key"):
        out = out.withColumn(f"{col}_spread", spread_nulls(F.col(col), "incoming_id"))
    out = (
        out.join(crm, F.col("crm_id_spread") == F.col("_crm"), "left").join(mail, F.col("_mail_key_spread") == F.col("_mail"), "left")
        .join(named, F.col("_person_key_spread") == F.col("_person"), "left")
    )
    tier = F.when(F.col("_crm").isNotNull(), "id").when(F.col("_mail").isNotNull(), "email").when(
        F.col("_person").isNotNull(), "name and company").otherwise("none")
    pick = F.col("match_tier")
    return out.withColumn("match_tier", tier).select(
        "incoming_id", "match_tier",
        F.when(pick == "id", F.col("crm_lead")).when(pick == "email", F.col("mail_lead"))
        .when(pick == "name and company", F.col("person_lead")).alias("candidate_id"),
        F.when(pick == "id", F.col("crm_n")).when(pick == "email", F.col("mail_n"))
        .when(pick == "name and company", F.col("person_n")).otherwise(0).alias("candidates"),
        F.when(pick == "id", F.col("crm_id")).when(pick == "email", F.col("_mail_key")).when(pick == "name and company", F.col("_person_key")).alias("match_key"),
    )


def match_candidates(matches: DataFrame, leads: DataFrame) -> DataFrame:
    """Every lead behind a match, by tier and key: what to show next to the incoming row before anyone merges."""
    keys = F.array(
        F.struct(F.lit("id").alias("match_tier"), F.col("crm_id").alias("match_key")),
        F.struct(F.lit("email").alias("match_tier"), F.lower("email").alias("match_key")),
        F.struct(F.lit("name and company").alias("match_tier"), person_key().alias("match_key")),
    )
    listed = leads.select("lead_id", F.explode(keys).alias("k")).select("k.*", "lead_id").filter(F.col("match_key").isNotNull())
    return listed.join(matches.filter(F.col("match_key").isNotNull()).select("match_tier", "match_key").distinct(), ["match_tier", "match_key"], "left_semi")


def duplicate_leads(leads: DataFrame) -> DataFrame:
    """Candidate duplicates: every further lead of a group with the first lead of that group.

    Naming the first member instead of all pairs keeps the output as long as the input.
    """
    def groups(key: Column, tier: str) -> DataFrame:
        keyed = leads.select(key.alias("_key"), "lead_id").filter(F.col("_key").isNotNull())
        first = keyed.groupBy("_key").agg(F.min("lead_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        return keyed.join(first, "_key").filter(F.col("lead_id") > F.col("first_id")).select(
            "first_id", F.col("lead_id").alias("other_id"), F.lit(tier).alias("tier")
        )

    return groups(F.lower("email"), "email").unionByName(groups(person_key(), "name and company"))


def convert_leads(leads: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Deals opened from qualified leads, and the leads with the link back."""
    opp = F.when(F.col("status") == "Qualified", F.col("lead_id") + first_id)
    linked = leads.withColumn("converted_opp_id", opp)
    deals = linked.filter(F.col("converted_opp_id").isNotNull()).select(
        F.col("converted_opp_id").alias("opp_id"), "company", "source", "source_detail", F.col("interest").alias("product_interest"),
        F.col("name").alias("champion"), "owner", F.col("lead_id").alias("from_lead"),
    )
    return deals, linked


def lead_shape(leads: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """What arrived: how many can be contacted, are in a sequence, lack an address or lie untouched."""
    quiet = F.col("last_activity").isNull() | (F.datediff(F.lit(as_of).cast("date"), F.col("last_activity")) >= days)
    return contactable_gate(leads).agg(
        F.count(F.lit(1)).alias("leads"), F.count_if("contactable").alias("contactable"), F.count_if("in_sequence").alias("in_sequence"),
        F.count_if(F.col("email").isNull()).alias("no_email"), F.count_if(quiet).alias("untouched"),
    )


def disqualification_runs(leads: DataFrame) -> DataFrame:
    """Poor fit against not interested, by source."""
    return leads.filter(F.col("dq_reason").isNotNull()).groupBy("source").agg(
        F.count_if(F.col("dq_reason") == "Poor fit").alias("poor_fit"),
        F.count_if(F.col("dq_reason") == "Not interested").alias("not_interested"),
    )


def rep_unworked(leads: DataFrame) -> DataFrame:
    return leads.groupBy("owner").agg(
        F.count_if((F.col("status") == "New") & F.col("last_activity").isNull()).alias("unworked_new"),
        F.count_if(F.col("replied_to_sequence")).alias("unanswered_replies"),
    )


def lead_flow_trend(leads: DataFrame) -> DataFrame:
    return contactable_gate(leads).groupBy(F.date_trunc("week", "created").cast("date").alias("week"), "source").agg(
        F.count(F.lit(1)).alias("leads"),
        F.try_divide(F.count_if("contactable").cast("double"), F.count(F.lit(1)).cast("double")).alias("contactable_share"),
    )


def unsourced_leads(leads: DataFrame) -> DataFrame:
    return leads.agg(
        F.count_if(F.col("source").isNull()).alias("unsourced"), F.count(F.lit(1)).alias("leads"),
    ).withColumn("share", F.try_divide(F.col("unsourced").cast("double"), F.col("leads").cast("double")))


def picklist_check(df: DataFrame, picklists: Mapping[str, Sequence[str]]) -> DataFrame:
    """Names of the columns whose value is not on the org's list; the record itself is kept."""
    return df.withColumn("unknown_values", flag_list(
        *[(F.col(c).isNotNull() & ~F.col(c).isin(*values), c) for c, values in picklists.items()]
    ))


def required_guard(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the rest with the reasons; a rule that is null is not met."""
    reasons = flag_list(*[(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])
    checked = df.withColumn("reasons", reasons)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def apply_field_map(df: DataFrame, field_map: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{source}`").alias(local) for source, local in field_map.items()])


def scope_filter(df: DataFrame, scope: str, owner: int | None = None, roster: DataFrame | None = None, second: str | None = None) -> DataFrame:
    """`individual` keeps the user's rows (either owner column), `team` the rows of the roster."""
    if scope == "individual":
        mine = F.col("owner") == owner
        return df.filter(mine | (F.col(second) == owner) if second else mine)
    if scope == "team":
        reps = roster.select(F.col("rep").cast("long").alias("owner")).distinct()
        return df.join(reps, "owner", "left_semi")
    raise ValueError(f"unknown scope {scope!r}")


def default_filter(df: DataFrame, keep: str, ignore_fields: Sequence[str] = ()) -> DataFrame:
    """The profile's default condition, without the fields the org ruled out."""
    return df.filter(F.expr(keep)).drop(*ignore_fields)


def plan_extract(df: DataFrame, field_map: Mapping[str, str], scope: str, keep: str, owner: int | None = None, roster: DataFrame | None = None) -> DataFrame:
    """Mapped columns of the rows in scope; both filters reach the scan."""
    return apply_field_map(default_filter(scope_filter(df, scope, owner, roster), keep), field_map)
