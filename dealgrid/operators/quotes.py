"""Quotes: tiers found from quantity, guard rails, approval, totals, versions and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import SAMPLE_FLOOR, flag_list, guarded_rate
from dealgrid.operators.forecast import MONEY
from dealgrid.operators.sequences import ordered_history

APPROVAL_THRESHOLD = 0.06


def tiers_of(price_list: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """Volume tiers as rows from the list price and the percent of it each quantity step keeps."""
    rows = F.array(*[F.struct(F.lit(q).cast("long").alias("min_qty"), F.lit(keep).alias("keep")) for q, keep in steps])
    tiers = price_list.select("sku", "list_price", F.explode(rows).alias("t"))
    return tiers.select("sku", F.col("t.min_qty").alias("min_qty"), (F.col("list_price") * F.col("t.keep") / 100).cast(MONEY).alias("price"))


def tier_ladder(tiers: DataFrame) -> DataFrame:
    """All tiers of a SKU in one sorted array, one entry per quantity step."""
    steps = tiers.groupBy("sku", "min_qty").agg(F.max("price").alias("price"))
    return steps.groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("min_qty", "price"))).alias("_ladder"))


def _reached(qty: Column) -> Column:
    return F.try_element_at(F.filter("_ladder", lambda t: t["min_qty"] <= qty), F.lit(-1))


def _next(qty: Column) -> Column:
    return F.get(F.filter("_ladder", lambda t: t["min_qty"] > qty), 0)


def resolve_tier_price(lines: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier and unit price from the quantity: one row per line, no range join."""
    j = lines.join(tier_ladder(tiers), "sku", "left")
    return j.withColumn("_tier", _reached(F.col("qty"))).withColumn("tier_qty", F.col("_tier.min_qty")).withColumn("unit_price", F.col("_tier.price")).drop("_tier", "_ladder")


def estimate_value(wanted: DataFrame, tiers: DataFrame) -> DataFrame:
    """Value at the tier price and at list, with the next tier's threshold and price."""
    j = wanted.join(tier_ladder(tiers), "sku", "left")
    q = F.col("qty")
    return j.select(
        *wanted.columns, (_reached(q)["price"] * q).cast(MONEY).alias("estimate"),
        (F.get("_ladder", 0)["price"] * q).cast(MONEY).alias("at_list"),
        _next(q)["min_qty"].alias("next_qty"), _next(q)["price"].alias("next_price"),
    )


def quote_guardrails(lines: DataFrame, price_list: DataFrame, tiers: DataFrame, as_of: str) -> DataFrame:
    """Problems that refuse a line; the net unit price is the tier price less the discount."""
    p = price_list.select("sku", F.lit(True).alias("_listed"), "floor_price", "increment", "min_qty_sold", F.col("status").alias("price_status"), "expires")
    j = resolve_tier_price(lines, tiers).join(p, "sku", "left")
    net = (F.col("unit_price") * (F.lit(1) - F.col("discount"))).cast(MONEY)
    problems = flag_list(
        (F.col("_listed").isNull(), "not on the list"),
        (F.col("qty") < F.col("min_qty_sold"), "under minimum"),
        (F.pmod(F.col("qty"), F.col("increment")) != 0, "off increment"),
        (F.col("price_status") == "Deprecated", "price deprecated"),
        (F.col("expires") < F.lit(as_of).cast("date"), "price expired"),
        ((F.col("discount") > 0) & F.col("discount_reason").isNull(), "discount without reason"),
        (net < F.col("floor_price"), "under floor"),
    )
    return j.withColumn("net_price", net).withColumn("problems", problems)


def quote_totals(lines: DataFrame) -> DataFrame:
    """Extended, discount, net and blended discount per quote, in decimals."""
    off = (F.col("extended") * F.col("discount")).cast("decimal(18,4)")
    sums = lines.groupBy("quote_id").agg(
        F.sum("extended").cast(MONEY).alias("extended"), F.sum(off).cast("decimal(20,4)").alias("_off"), F.count(F.lit(1)).alias("lines"))
    return sums.select(
        "quote_id", "lines", "extended", F.round("_off", 2).cast(MONEY).alias("discount_total"),
        (F.col("extended") - F.round("_off", 2)).cast(MONEY).alias("net"),
        F.try_divide(F.col("_off").cast("double"), F.col("extended").cast("double")).alias("blended_discount"),
    )


def quote_approval(lines: DataFrame, price_list: DataFrame, threshold: float = APPROVAL_THRESHOLD) -> DataFrame:
    """Quotes that need approval: a line over its SKU's own limit, or the blended discount over the org's."""
    limits = price_list.select("sku", "max_discount")
    over = lines.join(limits, "sku", "left").groupBy("quote_id").agg(F.count_if(F.col("discount") > F.col("max_discount")).alias("lines_over"))
    j = quote_totals(lines).join(over, "quote_id")
    by_line, by_total = F.col("lines_over") > 0, F.col("blended_discount") > threshold
    return j.select(
        "quote_id", (by_line | by_total).alias("needs_approval"),
        F.concat_ws("; ", F.when(by_line, F.concat(F.col("lines_over").cast("string"), F.lit(" lines over the SKU limit"))),
                    F.when(by_total, F.lit("blended discount over the threshold"))).alias("approval_reason"),
    )


def quote_versions(quotes: DataFrame) -> DataFrame:
    """Versions per account in order of issue; a later one supersedes the one before."""
    seq = ordered_history(quotes, ["account"], ["issued", "quote_id"], F.col("issued"),
                          prev={"supersedes": "quote_id"}, following={"_later": "quote_id"}, number="version")
    return seq.select("quote_id", "account", "version", "supersedes", F.when(F.col("_later").isNull(), "live").otherwise("superseded").alias("status"))


def quote_vs_opportunity(
    totals: DataFrame, quotes: DataFrame, opps: DataFrame, rates: DataFrame, as_of: str, base: str = "USD", source: str = "crm"
) -> DataFrame:
    """Quote net next to the deal amount; a difference only where both are in one currency, else the net in the deal's currency.

    The converted figure is in cents at the rates of the day, for reading and never for writing back; it is null without a rate.
    """
    q = totals.select("quote_id", "net").join(quotes.select("quote_id", "opp_id", F.col("currency").alias("quote_currency")), "quote_id")
    j = q.join(opps.select("opp_id", "amount", F.col("currency").alias("deal_currency")), "opp_id")
    same = F.col("quote_currency") == F.col("deal_currency")
    spot = rates.filter((F.col("source") == source) & (F.col("effective_from") <= F.lit(as_of).cast("date"))).groupBy("currency").agg(F.max_by("rate", "effective_from").alias("_rate"))
    # As many rates as currencies: quotes look theirs up and aren't dealt out by currency.
    table = spot.filter(F.col("currency").isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct("currency", "_rate")))).scalar()
    rate = lambda side: F.when(F.col(f"{side}_currency") == base, F.lit(1).cast("decimal(18,8)")).otherwise(F.try_element_at(table, F.col(f"{side}_currency")))
    # Whole numbers throughout: a quotient that is cut to some digits first can be rounded up twice.
    whole = lambda c, digits: (c * 10**digits).cast("decimal(18,0)")
    top, under = whole(F.col("net"), 2) * whole(rate("quote"), 8), whole(rate("deal"), 8)
    half = F.when(top < 0, -under).otherwise(under)
    j = j.withColumns({"_top": (2 * top + half).cast("decimal(38,0)"), "_under": F.nullif((2 * under).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))})
    cents = F.expr("_top div _under")
    return j.select("quote_id", "opp_id", "net", "amount", "quote_currency", "deal_currency", same.alias("same_currency"),
                    F.when(same, (F.col("net") - F.col("amount")).cast(MONEY)).alias("delta"),
                    F.when(~same, cents).alias("net_in_deal_currency_cents"))


def quote_outcomes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Acceptance of decided quotes by discount reason."""
    decided = quotes.filter(F.col("outcome").isNotNull()).select("quote_id", "outcome")
    reasons = lines.filter(F.col("discount") > 0).select("quote_id", F.coalesce("discount_reason", F.lit("none given")).alias("reason")).distinct()
    won = F.count_if(F.col("outcome") == "Accepted")
    return reasons.join(decided, "quote_id").groupBy("reason").agg(
        F.count(F.lit(1)).alias("quotes"), won.alias("accepted"), guarded_rate(won, F.count(F.lit(1)), SAMPLE_FLOOR).alias("acceptance"))


def always_discounted(lines: DataFrame) -> DataFrame:
    """SKUs that never sold at list."""
    return lines.groupBy("sku").agg(F.min("discount").alias("least"), F.count(F.lit(1)).alias("lines")).filter(F.col("least") > 0).select("sku", "lines", "least")


def quotes_expiring(quotes: DataFrame, tasks: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Undecided quotes close to their last day that no open task follows up."""
    left = F.datediff("valid_until", F.lit(as_of).cast("date"))
    live = quotes.filter(F.col("outcome").isNull() & left.between(0, days))
    chased = tasks.filter(F.col("status") != "Done").select(F.col("related_id").alias("opp_id"))
    return live.join(chased, "opp_id", "left_anti").select("quote_id", "opp_id", "valid_until", left.alias("days_left"))


def quotes_lapsed(quotes: DataFrame, tasks: DataFrame, as_of: str) -> DataFrame:
    """Undecided quotes past their last day that nobody chased, by whether they were ever sent."""
    late = F.datediff(F.lit(as_of).cast("date"), F.col("valid_until"))
    dead = quotes.filter(F.col("outcome").isNull() & (late > 0))
    chased = tasks.select(F.col("related_id").alias("opp_id"))
    return dead.join(chased, "opp_id", "left_anti").groupBy(F.col("sent_date").isNotNull().alias("was_sent")).agg(
        F.count(F.lit(1)).alias("quotes"), F.max(late).alias("longest_days"))
