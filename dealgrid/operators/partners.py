"""Partners: conflict by tier, claims, performance, health and forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgrid.functions.columns import SAMPLE_FLOOR, flag_list, guarded_rate, list_permits, sample_note, split_list, whole_months_since
from dealgrid.operators.forecast import MONEY, total
from dealgrid.operators.sequences import asof_by_day, top_per_key
from dealgrid.session import broadcast_if_small, cut_lineage

# Severity of each finding.
SEVERITY = {
    "same tier claimed": "BLOCK", "role not permitted": "BLOCK", "direct opportunity": "BLOCK",
    "teaming": "note", "already holds this tier": "note", "existing customer": "CHECK",
    "territory mismatch": "CHECK", "exclusive territory": "CHECK", "named account of another": "CHECK",
    "expired claim": "CHECK", "distributor not free": "CHECK",
}
# The tiers of a sell-through deal.
TIERS = ("Distributor", "Reseller")
LAPSED = "lapsed"

EXPIRING_DAYS = 14
SELL_THROUGH_FACTOR = 0.7


def finding(df: DataFrame, name: Column | str, detail: Column, others: Column | None = None) -> DataFrame:
    label = F.lit(name) if isinstance(name, str) else name
    grade = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    count = F.lit(None) if others is None else others
    return df.select(
        "submission_id", label.alias("finding"), F.try_element_at(grade, label).alias("severity"), detail.cast("string").alias("detail"), count.cast("long").alias("others")
    )


def _found(cond: Column, name: str, detail: Column, others: Column | None = None) -> Column:
    count = F.lit(None) if others is None else others
    return F.when(cond, F.struct(F.lit(name).alias("finding"), F.lit(SEVERITY[name]).alias("severity"), detail.cast("string").alias("detail"), count.cast("long").alias("others")))


def _findings(submissions: DataFrame, parts: list[Column]) -> DataFrame:
    """The findings of each submission as rows, all from one pass."""
    return submissions.select("submission_id", F.explode(F.array_compact(F.array(*parts))).alias("f")).select("submission_id", "f.*")


def registration_clock(regs: DataFrame, as_of: str) -> DataFrame:
    """Protection end from the days agreed at approval, and the state of the claim."""
    day = F.lit(as_of).cast("date")
    out = regs.withColumn("expires", F.date_add("approved", F.col("protection_days")))
    left = F.datediff("expires", day)
    return out.withColumn("state", F.when(left < 0, "lapsed").when(left <= EXPIRING_DAYS, "expiring").otherwise("live"))


def live_claims(regs: DataFrame, as_of: str) -> DataFrame:
    return registration_clock(regs, as_of).filter(F.col("state") != "lapsed")


def holder_class(tier: Column) -> Column:
    """The holders of a tier at a customer, or of lapsed claims there, as one class."""
    return F.concat_ws("/", F.col("customer_key"), tier)


def claim_holders(regs: DataFrame, as_of: str) -> DataFrame:
    """Everyone behind a class that a finding names: holder_class, partner_id, state, approved, expires."""
    clock = registration_clock(regs, as_of)
    tier = F.when(F.col("state") == "lapsed", LAPSED).otherwise(F.col("role"))
    return clock.select(holder_class(tier).alias("holder_class"), "partner_id", "state", "approved", "expires")


def partner_claims(clock: DataFrame) -> DataFrame:
    """One row per customer and partner with a flag for each live tier and for lapsed claims, from `registration_clock`."""
    live = F.col("state") != "lapsed"
    flags = [F.max(F.when(live & (F.col("role") == tier), 1).otherwise(0)).alias(f"_{tier}") for tier in TIERS]
    return clock.groupBy("customer_key", "partner_id").agg(*flags, F.max(F.when(~live, 1).otherwise(0)).alias(f"_{LAPSED}"))


def holder_counts(held: DataFrame) -> list[Column]:
    return [F.sum(f"_{c}").alias(f"_n_{c}") for c in (*TIERS, LAPSED)]


def _held(submissions: DataFrame, clock: DataFrame) -> DataFrame:
    """Submissions next to the number of holders of each class at their customer, and which of them the partner is."""
    held = partner_claims(clock)
    return submissions.join(held.groupBy("customer_key").agg(*holder_counts(held)), "customer_key").join(held, ["customer_key", "partner_id"], "left")


def other_holders(kind: str) -> Column:
    return F.coalesce(F.col(f"_n_{kind}"), F.lit(0)) - F.coalesce(F.col(f"_{kind}"), F.lit(0))


def conflict_same_tier(submissions: DataFrame, regs: DataFrame, as_of: str) -> DataFrame:
    """Other partners hold a live claim on this tier for this customer: their class and how many they are.

    Claims fold to one row per customer and partner, and those to counts, so a customer with many claims adds no rows; `claim_holders` names them.
    """
    j = _held(submissions, registration_clock(regs, as_of))
    return _findings(j, [_found((F.col("role") == t) & (other_holders(t) > 0), "same tier claimed", holder_class(F.lit(t)), other_holders(t)) for t in TIERS])


def conflict_role(submissions: DataFrame, partners: DataFrame) -> DataFrame:
    allowed = partners.select(F.col("partner_id").alias("_pid"), split_list(F.col("roles_supported")).alias("_roles"))
    bad = submissions.join(allowed, F.col("partner_id") == F.col("_pid")).filter(~list_permits(F.col("_roles"), F.col("role")))
    return finding(bad, "role not permitted", F.col("role"))


def conflict_direct(submissions: DataFrame, opps: DataFrame) -> DataFrame:
    """We have our own open deal there (one without a partner)."""
    direct = opps.filter(F.col("is_open") & F.col("partner_id").isNull()).select(F.col("customer_key"))
    return finding(submissions.join(direct, "customer_key", "left_semi"), "direct opportunity", F.col("customer_key"))


def conflict_customer(submissions: DataFrame, customers: DataFrame) -> DataFrame:
    return finding(
        submissions.join(customers.select("customer_key"), "customer_key", "left_semi"), "existing customer", F.col("customer_key")
    )


def with_territory(submissions: DataFrame, partners: DataFrame) -> DataFrame:
    """Submissions with `_territory`, the names of their territory findings, and the partner's `_roles`.

    A named account overrides geography in both directions.
    """
    own = partners.select(
        F.col("partner_id").alias("_pid"), split_list(F.col("roles_supported")).alias("_roles"),
        split_list(F.col("countries")).alias("_countries"), split_list(F.col("segments_served")).alias("_segments"),
        split_list(F.col("excluded_accounts")).alias("_excluded"),
    )
    pairs = partners.select(
        F.col("partner_id").alias("_owner"), F.explode(split_list(F.col("named_accounts"))).alias("_account")
    ).distinct()
    named = pairs.select(F.col("_account").alias("_named")).distinct()
    exclusive = (
        partners.select("partner_id", F.explode(split_list(F.col("exclusive_territory"))).alias("_area")).groupBy("_area")
        .agg(F.min("partner_id").alias("_xlow"), F.max("partner_id").alias("_xhigh"))
    )
    j = (
        submissions.join(own, F.col("partner_id") == F.col("_pid"), "left")
        .join(named, F.col("customer").cast("string") == F.col("_named"), "left")
        .join(pairs, (F.col("customer").cast("string") == F.col("_account")) & (F.col("partner_id") == F.col("_owner")), "left")
        .join(exclusive, F.col("country") == F.col("_area"), "left")
    )
    mine = F.col("_owner").isNotNull()
    outside = ~list_permits(F.col("_countries"), F.col("country")) | ~list_permits(F.col("_segments"), F.col("segment"))
    excluded = F.coalesce(F.array_contains("_excluded", F.col("customer").cast("string")), F.lit(False))
    in_exclusive = F.col("_area").isNotNull() & ((F.col("_xlow") != F.col("partner_id")) | (F.col("_xhigh") != F.col("partner_id")))
    names = flag_list(
        (F.col("_pid").isNotNull() & ~mine & (outside | excluded), "territory mismatch"),
        (~mine & in_exclusive, "exclusive territory"),
        (F.col("_named").isNotNull() & ~mine, "named account of another"),
    )
    return j.withColumn("_territory", names).select(*submissions.columns, "_pid", "_roles", "_territory")


def conflict_territory(submissions: DataFrame, partners: DataFrame) -> DataFrame:
    """Outside countries or segments, on the excluded list, in another's exclusive area, or another's named account."""
    rows = with_territory(submissions, partners).withColumn("_finding", F.explode("_territory"))
    return finding(rows, F.col("_finding"), F.concat_ws("/", "country", "segment"))


def conflict_teaming(submissions: DataFrame, regs: DataFrame, as_of: str) -> DataFrame:
    """Notes: other partners hold a different tier, with their class and number, or this partner already holds this tier."""
    j = _held(submissions, registration_clock(regs, as_of))
    parts = [_found((F.col("role") != t) & (other_holders(t) > 0), "teaming", holder_class(F.lit(t)), other_holders(t)) for t in TIERS]
    parts += [_found((F.col("role") == t) & (F.col(f"_{t}") > 0), "already holds this tier", F.col("role")) for t in TIERS]
    return _findings(j, parts)


def conflict_expired(submissions: DataFrame, regs: DataFrame, as_of: str) -> DataFrame:
    """Lapsed claims of other partners on this customer: their class and how many partners they are."""
    j = _held(submissions, registration_clock(regs, as_of))
    return finding(j.filter(other_holders(LAPSED) > 0), "expired claim", holder_class(F.lit(LAPSED)), other_holders(LAPSED))


def distributor_consistency(submissions: DataFrame, claims: DataFrame) -> DataFrame:
    """On a two-tier submission the named distributor holds, or is free to hold, the distributor tier."""
    tier = claims.filter(F.col("role") == "Distributor").select(F.col("customer_key").alias("_ck")).distinct()
    named = submissions.filter(F.col("distributor").isNotNull() & (F.col("role") != "Distributor"))
    j = named.join(tier, F.col("customer_key") == F.col("_ck"), "left")
    holds = claims.filter(F.col("role") == "Distributor").select("customer_key", F.col("partner_id").alias("distributor"), F.lit(True).alias("_holds")).distinct()
    j = j.join(holds, ["customer_key", "distributor"], "left")
    state = F.when(F.col("_holds"), "holds the tier").when(F.col("_ck").isNull(), "free").otherwise("held by another")
    return j.select("submission_id", "distributor", state.alias("distributor_state"), (state != "held by another").alias("consistent"))


def customer_facts(held: DataFrame, opps: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per customer: number of holders of each class, own open deals, and whether they buy already.

    `partner_claims`, deals and customers are stacked and grouped once.
    """
    direct = opps.filter(F.col("is_open") & F.col("partner_id").isNull()).select("customer_key", F.lit(True).alias("_direct"))
    buys = customers.select("customer_key", F.lit(True).alias("_buys"))
    stacked = held.drop("partner_id").unionByName(direct, allowMissingColumns=True).unionByName(buys, allowMissingColumns=True)
    return stacked.groupBy("customer_key").agg(*holder_counts(held), F.bool_or("_direct").alias("_direct"), F.bool_or("_buys").alias("_buys"))


def conflict_check(
    submissions: DataFrame, regs: DataFrame, partners: DataFrame, opps: DataFrame, customers: DataFrame, as_of: str
) -> DataFrame:
    """All findings of a batch of submissions, in one pass over the batch. The claims are folded once and landed, as they are looked up twice."""
    held = cut_lineage(partner_claims(registration_clock(regs, as_of)), "partner-claims")
    j = (
        with_territory(submissions, partners).join(customer_facts(held, opps, customers), "customer_key", "left")
        .join(held, ["customer_key", "partner_id"], "left")
    )
    place = F.concat_ws("/", "country", "segment")
    parts = [
        _found(~list_permits(F.col("_roles"), F.col("role")) & F.col("_pid").isNotNull(), "role not permitted", F.col("role")),
        _found(F.col("_direct"), "direct opportunity", F.col("customer_key")), _found(F.col("_buys"), "existing customer", F.col("customer_key")),
        _found(other_holders(LAPSED) > 0, "expired claim", holder_class(F.lit(LAPSED)), other_holders(LAPSED)),
    ]
    for tier in TIERS:
        parts.append(_found((F.col("role") == tier) & (other_holders(tier) > 0), "same tier claimed", holder_class(F.lit(tier)), other_holders(tier)))
        parts.append(_found((F.col("role") != tier) & (other_holders(tier) > 0), "teaming", holder_class(F.lit(tier)), other_holders(tier)))
        parts.append(_found((F.col("role") == tier) & (F.col(f"_{tier}") > 0), "already holds this tier", F.col("role")))
    for name in ("territory mismatch", "exclusive territory", "named account of another"):
        parts.append(_found(F.array_contains("_territory", name), name, place))
    return _findings(j, parts)


def conflict_verdict(submissions: DataFrame, findings: DataFrame) -> DataFrame:
    """Worst severity and number of findings of each submission."""
    rank = F.when(F.col("severity") == "BLOCK", 3).when(F.col("severity") == "CHECK", 2).otherwise(1)
    worst = findings.groupBy("submission_id").agg(F.max(rank).alias("_worst"), F.count(F.lit(1)).alias("findings"))
    names = F.create_map(F.lit(3), F.lit("BLOCK"), F.lit(2), F.lit("CHECK"), F.lit(1), F.lit("note"))
    return submissions.select("submission_id").join(worst, "submission_id", "left").select(
        "submission_id", F.coalesce(F.try_element_at(names, "_worst"), F.lit("clear")).alias("verdict"), F.coalesce("findings", F.lit(0)).alias("findings")
    )


def partner_deals(opps: DataFrame, regs: DataFrame, partner: int | None = None) -> DataFrame:
    """Deals that carry a partner (or one partner), with the registrations neither side links to a deal."""
    linked = opps.filter(F.col("deal_registration_id").isNotNull()).select(F.col("deal_registration_id").alias("reg_id"))
    loose = regs.filter(F.col("opportunity_id").isNull()).join(linked, "reg_id", "left_anti")
    deals = opps.filter(F.col("partner_id").isNotNull()).select(
        F.lit("deal").alias("kind"), "partner_id", "account", F.col("opp_id").cast("string").alias("ref"), "amount")
    claims = loose.select(
        F.lit("registration").alias("kind"), "partner_id", F.col("customer").alias("account"), F.col("reg_id").alias("ref"),
        F.lit(None).cast(MONEY).alias("amount"))
    both = deals.unionByName(claims)
    return both if partner is None else both.filter(F.col("partner_id") == partner)


def holder_timeline(regs: DataFrame) -> DataFrame:
    """Who holds a tier at a customer when: customer, role, start, until, holder; spans that don't overlap.

    Of claims live on a day the one approved first holds, then the lowest partner. A claim's span starts when all before it have lapsed. Claims fold to one row
    per customer, tier, approval and end first, so a window holds no more rows than there are days and terms.
    """
    terms = regs.groupBy("customer", "role", "approved", "expires").agg(F.min("partner_id").alias("holder"))
    before = Window.partitionBy("customer", "role").orderBy("approved", "holder", "expires").rowsBetween(Window.unboundedPreceding, -1)
    free = F.date_add(F.max("expires").over(before), 1)
    return terms.withColumn("start", F.greatest("approved", free)).filter(F.col("start") <= F.col("expires")).select(
        "customer", "role", "start", F.col("expires").alias("until"), "holder")


def tier_attribution(opps: DataFrame, regs: DataFrame) -> DataFrame:
    """Credit per tier: opp_id, tier, credited_partner, basis; one row for each tier someone earns, or the deal's own partner where nobody does.

    For each tier of a deal the registration counts that the deal names, or that names the deal; then the claim that held the tier on the deal's
    day; then the claim that lapsed last before it, with a note. `regs` holds reg_id, customer, role, partner_id, approved, expires and opportunity_id.
    """
    deals = opps.filter(F.col("partner_id").isNotNull()).select("opp_id", F.col("account").alias("customer"), "partner_id", F.col("created").alias("day"), "deal_registration_id")
    spots = deals.select("opp_id", "customer", "day", F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("role"))
    named = deals.filter(F.col("deal_registration_id").isNotNull()).select("opp_id", F.col("deal_registration_id").alias("reg_id")).join(
        regs.select("reg_id", "role", "approved", "partner_id"), "reg_id").select("opp_id", "role", F.struct(F.lit(0).alias("k"), "approved", "partner_id").alias("_r"))
    naming = regs.filter(F.col("opportunity_id").isNotNull()).select(
        F.col("opportunity_id").alias("opp_id"), "role", F.struct(F.lit(1).alias("k"), "approved", "partner_id").alias("_r"))
    linked = named.unionByName(naming).groupBy("opp_id", "role").agg(F.min("_r").alias("_linked"))
    keys = ["customer", "role"]
    j = asof_by_day(spots, holder_timeline(regs), keys, "day", "start", F.struct("start", "until", "holder"), "_live")
    j = asof_by_day(j, regs.select(*keys, "expires", (-F.col("partner_id")).alias("_p")), keys, "day", "expires", F.struct("expires", "_p"), "_old", strict=True)
    j = j.join(linked, ["opp_id", "role"], "left")
    held = F.col("_live.until") >= F.col("day")
    basis = F.when(F.col("_linked").isNotNull(), "registration").when(held, "live claim").when(F.col("_old").isNotNull(), "lapsed claim, note")
    who = F.when(F.col("_linked").isNotNull(), F.col("_linked.partner_id")).when(held, F.col("_live.holder")).otherwise(-F.col("_old._p"))
    earned = j.select("opp_id", F.col("role").alias("tier"), who.alias("credited_partner"), basis.alias("basis")).filter(F.col("basis").isNotNull())
    nobody = deals.join(earned.select("opp_id"), "opp_id", "left_anti").select(
        "opp_id", F.lit("unknown").alias("tier"), F.col("partner_id").alias("credited_partner"), F.lit("deal partner").alias("basis"))
    return earned.unionByName(nobody)


_BY_NET = ("margin_pct", "partner_id")
#: Partners in a block of an area's list.
ROUTE_BLOCK = 1024


def able_partners(partners: DataFrame, as_of: str, role: str = "Reseller") -> DataFrame:
    """Partners that are enabled on a day and may act in a role."""
    return partners.filter((F.col("enabled_until") >= F.lit(as_of).cast("date")) & list_permits(split_list(F.col("roles_supported")), F.lit(role)))


def route_areas(accounts: DataFrame, able: DataFrame, k: int | None = None) -> DataFrame:
    """The partners that serve each country and segment with accounts, by net: country, segment, rank, partner_id, margin_pct."""
    area = able.select(
        "partner_id", "margin_pct", F.explode(split_list(F.col("countries"))).alias("country"),
        split_list(F.col("segments_served")).alias("_segments"),
    )
    area = area.withColumn("segment", F.explode(F.coalesce("_segments", F.array(F.lit("any"))))).drop("_segments")
    spots = accounts.select(F.col("country").cast("string").alias("country"), "segment").distinct()
    served = spots.join(area.filter(F.col("segment") != "any"), ["country", "segment"]).unionByName(
        spots.join(area.filter(F.col("segment") == "any").drop("segment"), "country"))
    return top_per_key(served.select("country", "segment", *reversed(_BY_NET)), ["country", "segment"], [F.col(c) for c in _BY_NET], k)


def route_known(regs: DataFrame, able: DataFrame, k: int | None = None) -> DataFrame:
    """The partners each account already has, by net: account, rank, partner_id, margin_pct."""
    known = regs.select(F.col("customer").alias("account"), "partner_id").distinct().join(able.select(*_BY_NET), "partner_id")
    return top_per_key(known.select("account", *reversed(_BY_NET)), ["account"], [F.col(c) for c in _BY_NET], k)


def _unrouted(opps: DataFrame, accounts: DataFrame) -> DataFrame:
    place = accounts.select("account", F.col("country").cast("string").alias("country"), "segment")
    return opps.filter(F.col("is_open") & F.col("partner_id").isNull()).select("opp_id", "account", "amount").join(place, "account")


def route_deal(opps: DataFrame, accounts: DataFrame, areas: DataFrame, known: DataFrame) -> DataFrame:
    """Each open deal without a partner: where its candidates are listed, how many, and the first choice.

    opp_id, account, country, segment, known_partners, area_partners, partner_id, existing_relation, net_amount. The candidates are those of `route_known` under
    the account and those of `route_areas` under country and segment, in their order; a partner the account already has comes first.
    Lists are never copied to the deals, as all deals of an area share one.
    """
    first = lambda df, keys, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{n}_partners"), F.min(F.struct("rank", *_BY_NET)).alias(f"_{n}"))
    j = _unrouted(opps, accounts).join(first(areas, ["country", "segment"], "area"), ["country", "segment"], "left").join(first(known, ["account"], "known"), "account", "left")
    pick = F.coalesce("_known", "_area")
    net = (F.col("amount") * (F.lit(1) - pick["margin_pct"])).cast(MONEY)
    count = lambda c: F.coalesce(f"{c}_partners", F.lit(0)).alias(f"{c}_partners")
    return j.select("opp_id", "account", "country", "segment", count("known"), count("area"), pick["partner_id"].alias("partner_id"), F.col("_known").isNotNull().alias("existing_relation"), net.alias("net_amount"))


def _route_blocks(places: DataFrame, areas: DataFrame) -> DataFrame:
    """The partners of each set of areas by net, each once: place, partner_id, margin_pct, rank, and `_low`, the first rank of its block.

    A block has partners of one margin, ROUTE_BLOCK at most.
    """
    spots = places.select("place").distinct().select("place", F.explode("place").alias("_s")).select("place", "_s.*")
    served = spots.join(areas, ["country", "segment"]).groupBy("place", "partner_id").agg(F.max("margin_pct").alias("margin_pct"))
    ranked = top_per_key(served, ["place"], [F.col(c) for c in _BY_NET], None)
    first = F.min("rank").over(Window.partitionBy("place", "margin_pct"))
    return ranked.withColumn("_low", first + F.floor((F.col("rank") - first) / ROUTE_BLOCK).cast("int") * ROUTE_BLOCK)


def route_candidates(opps: DataFrame, accounts: DataFrame, areas: DataFrame, known: DataFrame) -> DataFrame:
    """All partners for each open deal without one, ranked: those the account already has first, then by net.

    The partners an account has are ranked for the account, those of an area once for the area, in blocks of one margin. A deal takes what its account has and every block
    of its area, without the partners that came first: net is worked out for a block, and a row is a step in it. No list is made for an account.
    The result has a row for each deal and partner of its area: it grows with the deals times the partners.
    """
    deals = _unrouted(opps, accounts)
    places = deals.groupBy("account").agg(F.sort_array(F.collect_set(F.struct("country", "segment"))).alias("place"))
    local = cut_lineage(_route_blocks(places, areas), "route-blocks")
    at = local.select("place", "partner_id", F.col("margin_pct").alias("_m"), F.col("rank").alias("_at"))
    has = known.join(places, "account").groupBy("account", "place", "partner_id").agg(F.max("margin_pct").alias("margin_pct")).join(at, ["place", "partner_id"], "left")
    has = top_per_key(has.withColumn("margin_pct", F.greatest("margin_pct", "_m")), ["account"], [F.col(c) for c in _BY_NET], None)
    net = (F.col("amount") * (F.lit(1) - F.col("margin_pct"))).cast(MONEY).alias("net_amount")
    first = deals.select("opp_id", "account", "amount").join(has, "account").select("opp_id", "rank", "partner_id", F.lit(True).alias("existing_relation"), net)
    held = has.groupBy("account").agg(F.count(F.lit(1)).cast("int").alias("_n"), F.array_sort(F.collect_list("_at")).alias("_held"))
    blocks, _ = broadcast_if_small(local.groupBy("place", "_low").agg(
        F.max("rank").alias("_high"), F.max("margin_pct").alias("margin_pct"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "partner_id"))), lambda x: x["partner_id"]).alias("_ids")), 10_000)
    # Stretches of an account's list between the partners that came first; `_more` is what ranks there move up by.
    cuts = F.concat(F.array(F.lit(0)), F.coalesce("_held", F.array().cast("array<int>")))
    spans = places.join(held, "account", "left").select("account", "place", F.coalesce("_n", F.lit(0)).alias("_n"), cuts.alias("_cuts"))
    spans = spans.select("account", "place", "_n", "_cuts", F.posexplode("_cuts").alias("_i", "_c")).select(
        "account", "place", (F.col("_c") + 1).alias("_a"), F.coalesce(F.get("_cuts", F.col("_i") + 1) - 1, F.lit(2**31 - 1)).alias("_b"), (F.col("_n") - F.col("_i")).alias("_more"))
    met = (F.col("_a") <= F.col("_high")) & (F.col("_b") >= F.col("_low"))
    # The net of a deal in a block is a column before rows are made: in one select with them it would be worked out for each.
    runs = deals.select("opp_id", "account", "amount").join(spans.filter("_a <= _b"), "account").join(blocks, "place").filter(met).select(
        "opp_id", net, "_low", "_ids", "_more", F.greatest("_a", "_low").alias("_a"), F.least("_b", "_high").alias("_b"))
    rest = runs.select("opp_id", "net_amount", "_low", "_ids", "_more", F.explode(F.sequence("_a", "_b")).alias("_r")).select(
        "opp_id", (F.col("_r") + F.col("_more")).alias("rank"), F.get("_ids", F.col("_r") - F.col("_low")).alias("partner_id"), F.lit(False).alias("existing_relation"), "net_amount")
    return first.unionByName(rest)


def route_top(opps: DataFrame, accounts: DataFrame, areas: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The first `k` partners for each open deal without one, a partner the account already has first, then by net; a deal chooses among at most 2 * k."""
    deals = _unrouted(opps, accounts)
    cut = lambda df: df.filter(F.col("rank") <= k).drop("rank")
    offers = deals.join(cut(areas), ["country", "segment"]).select("opp_id", "amount", "partner_id", "margin_pct", F.lit(0).alias("known"))
    offers = offers.unionByName(deals.join(cut(known), "account").select("opp_id", "amount", "partner_id", "margin_pct", F.lit(1).alias("known")))
    each = offers.groupBy("opp_id", "partner_id").agg(
        F.max("amount").alias("amount"), F.max("margin_pct").alias("margin_pct"), F.max("known").alias("known"))
    best = top_per_key(each, ["opp_id"], [F.col("known").desc(), *[F.col(c) for c in _BY_NET]], k)
    net = (F.col("amount") * (F.lit(1) - F.col("margin_pct"))).cast(MONEY)
    return best.select("opp_id", "rank", "partner_id", (F.col("known") == 1).alias("existing_relation"), net.alias("net_amount"))


def partner_performance(partners: DataFrame, opps: DataFrame, as_of: str, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Deals, gross, net of margin, win rate above the floor and months since the last deal, per partner."""
    won = F.col("stage") == "Closed Won"
    sums = opps.filter(F.col("partner_id").isNotNull()).groupBy("partner_id").agg(
        F.count(F.lit(1)).alias("deals"), F.count_if(won).alias("won"), F.count_if(~F.col("is_open")).alias("decided"),
        total(F.col("converted_amount"), won).alias("gross"), F.max("created").alias("_last"),
    )
    net = (F.col("gross") * (F.lit(1) - F.col("margin_pct"))).cast(MONEY)
    return partners.join(sums, "partner_id", "left").select(
        "partner_id", "motion", F.coalesce("deals", F.lit(0)).alias("deals"), "gross",
        F.when(F.col("motion") == "sell-through", net).otherwise(F.col("gross")).alias("net"),
        guarded_rate(F.col("won"), F.col("decided"), floor).alias("win_rate"), sample_note(F.col("won"), F.col("decided"), floor).alias("sample_note"),
        whole_months_since(F.col("_last"), F.lit(as_of).cast("date")).alias("months_since_last_deal"),
    )


def months_since_last_deal(opps: DataFrame, as_of: str) -> DataFrame:
    return opps.filter(F.col("partner_id").isNotNull()).groupBy("partner_id").agg(F.max("created").alias("last_deal")).select(
        "partner_id", "last_deal", whole_months_since(F.col("last_deal"), F.lit(as_of).cast("date")).alias("months"))


def partner_roster_ratio(partners: DataFrame, opps: DataFrame, as_of: str) -> DataFrame:
    """Partners on paper, with a deal this year, and with more than one."""
    year = opps.filter(F.col("partner_id").isNotNull() & (F.col("created") >= F.trunc(F.lit(as_of).cast("date"), "year")))
    per = year.groupBy("partner_id").agg(F.count(F.lit(1)).alias("_n"))
    return partners.select("partner_id").join(per, "partner_id", "left").agg(
        F.count(F.lit(1)).alias("nominal"), F.count_if(F.col("_n") > 0).alias("active"), F.count_if(F.col("_n") > 1).alias("repeat"))


def partner_forecast(opps: DataFrame, partners: DataFrame, factor: float = SELL_THROUGH_FACTOR) -> DataFrame:
    """Open partner deals by motion; sell-through is discounted, sell-with shows its attach rate."""
    motion = partners.select("partner_id", "motion")
    # Fold to one row per partner first: most deals have none, and those would meet in one task.
    per = opps.filter("is_open").groupBy("partner_id").agg(
        F.count(F.lit(1)).alias("_deals"), total(F.col("converted_amount")).alias("_gross"))
    live = per.join(motion, "partner_id", "left").groupBy("motion").agg(
        F.sum("_deals").alias("deals"), total(F.col("_gross")).alias("gross"))
    all_open = per.agg(F.sum("_deals").alias("n")).scalar()
    weight = F.when(F.col("motion") == "sell-through", factor).otherwise(1.0)
    return live.select(
        F.coalesce("motion", F.lit("direct")).alias("motion"), "deals", "gross", (F.col("gross").cast("double") * weight).alias("forecast"),
        F.when(F.col("motion") == "sell-with", F.try_divide(F.col("deals").cast("double"), all_open.cast("double"))).alias("attach_rate"))


def single_rep_dependency(opps: DataFrame) -> DataFrame:
    """Partners all of whose deals come from one rep; lowest and highest rep agree exactly then."""
    per = opps.filter(F.col("partner_id").isNotNull() & F.col("owner").isNotNull()).groupBy("partner_id").agg(
        F.min("owner").alias("owner"), F.max("owner").alias("_high"), F.count(F.lit(1)).alias("deals"))
    return per.filter((F.col("owner") == F.col("_high")) & (F.col("deals") > 1)).select("partner_id", "owner", "deals")


def partner_health(partners: DataFrame, opps: DataFrame, regs: DataFrame, as_of: str) -> DataFrame:
    """Health flags per partner."""
    day = F.lit(as_of).cast("date")
    deals = opps.filter(F.col("partner_id").isNotNull()).groupBy("partner_id").agg(
        F.max("created").alias("_last"), F.count_if(F.col("stage") == "Closed Won").alias("_won"))
    claims = regs.groupBy("partner_id").agg(F.count(F.lit(1)).alias("_claims"))
    lone = single_rep_dependency(opps).select("partner_id", F.lit(True).alias("_lone"))
    j = partners
    for side in (deals, claims, lone):
        j = j.join(side, "partner_id", "left")
    return j.select("partner_id", flag_list(
        (F.col("_last").isNull() | (F.datediff(day, F.col("_last")) > 90), "no-deals-90d"),
        ((F.col("motion") == "sell-through") & (F.col("enabled_until") < day), "enablement-lapsed"),
        (F.datediff(F.col("agreement_end"), day).between(0, 90), "agreement-expiring"),
        (F.col("_lone"), "single-rep-dependency"),
        (F.col("last_qbr").isNull() | (F.col("last_qbr") < F.add_months(day, -6)), "no-qbr"),
        ((F.col("_claims") > 0) & (F.coalesce("_won", F.lit(0)) == 0), "registered-never-closed"),
    ).alias("health_flags"))


def partner_coverage_gaps(opps: DataFrame, accounts: DataFrame, partners: DataFrame, since: str) -> DataFrame:
    """Country and segment with open demand but no partner that serves it and has won a deal begun since a day."""
    recent = F.col("created") >= F.lit(since).cast("date")
    producing = opps.filter((F.col("stage") == "Closed Won") & F.col("partner_id").isNotNull() & recent).select("partner_id")
    served = partners.join(producing, "partner_id", "left_semi").select(
        F.explode(split_list(F.col("countries"))).alias("country"), split_list(F.col("segments_served")).alias("_s"))
    by_segment = served.filter(F.col("_s").isNotNull()).select("country", F.explode("_s").alias("segment"))
    any_segment = served.filter(F.col("_s").isNull()).select("country")
    place = accounts.select("account", F.col("country").cast("string").alias("country"), "segment")
    demand = opps.filter("is_open").join(place, "account").groupBy("country", "segment").agg(
        F.count(F.lit(1)).alias("open_deals"), total(F.col("amount")).alias("open_amount"))
    return demand.join(by_segment, ["country", "segment"], "left_anti").join(any_segment, "country", "left_anti").select(
        "country", "segment", "open_deals", "open_amount")
