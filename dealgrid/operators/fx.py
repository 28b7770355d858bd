"""Currency conversion: rate as of a date, frozen at close, null and not zero without a rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgrid.functions.columns import invert_rate
from dealgrid.operators.sequences import asof_by_day
from dealgrid.session import broadcast_if_small

MONEY = "decimal(18,2)"
RATE = "decimal(18,8)"
STALE_DAYS = 30
DRIFT_LIMIT = 0.02
CLOSED_STAGES = ("Closed Won", "Closed Lost")


def load_rates(feed: DataFrame, convention: str = "units-of-currency-per-base") -> DataFrame:
    """Multipliers to the base currency; a feed quoted per base unit is inverted, once, here."""
    if convention == "units-of-currency-per-base":
        rate = invert_rate(F.col("units_per_base"))
    elif convention == "base-per-unit":
        rate = F.col("units_per_base").cast(RATE)
    else:
        raise ValueError(f"unknown rate convention {convention!r}")
    return feed.select("currency", rate.alias("rate"), "source", "effective_from")


def rate_spans(rates: DataFrame, source: str) -> DataFrame:
    """One row per currency and span of days in which its rate holds."""
    days = (
        rates.filter(F.col("source") == source)
        .groupBy("currency", "effective_from").agg(F.max("rate").alias("rate"))
    )
    w = Window.partitionBy("currency").orderBy("effective_from")
    return days.withColumn("until", F.lead("effective_from").over(w))


def with_rate(df: DataFrame, rates: DataFrame, day: str, source: str = "crm", max_rows: int = 100_000) -> DataFrame:
    """Add `rate` as of `day`.

    A rate table proven small is broadcast and joined on currency and span. A larger one goes
    through the as-of join by day, so the many rows of one currency spread over its days.
    """
    spans, small = broadcast_if_small(rate_spans(rates, source), max_rows)
    if small:
        spans = spans.withColumnRenamed("currency", "_ccy")
        hit = (
            (F.col("currency") == F.col("_ccy")) & (F.col(day) >= F.col("effective_from"))
            & (F.col("until").isNull() | (F.col(day) < F.col("until")))
        )
        return df.join(F.broadcast(spans), hit, "left").drop("_ccy", "effective_from", "until")
    points = rates.filter(F.col("source") == source)
    return asof_by_day(df, points, ["currency"], day, "effective_from", F.col("rate"), "rate")


def fx_convert(
    df: DataFrame,
    rates: DataFrame,
    as_of: str,
    base: str = "USD",
    source: str = "crm",
    amount: str = "amount",
    closed: Column | None = None,
    close_day: str = "close_date",
    frozen: str | None = None,
    max_rate_rows: int = 100_000,
) -> DataFrame:
    """Add converted_amount, rate_used and frozen.

    Open rows take the rate as of `as_of`. Closed rows take the rate of the day they closed, or the
    stored `frozen` value where there is one. The base currency has rate 1; no rate gives null.
    """
    closed = F.col("stage").isin(*CLOSED_STAGES) if closed is None else closed
    today = F.lit(as_of).cast("date")
    dated = df.withColumn("_closed", closed).withColumn(
        "_rate_day", F.when(F.col("_closed"), F.least(F.col(close_day), today)).otherwise(today)
    )
    rated = with_rate(dated, rates, "_rate_day", source, max_rate_rows)
    used = F.when(F.col("currency") == base, F.lit(1).cast(RATE)).otherwise(F.col("rate"))
    value = F.round(F.col(amount).cast(MONEY) * used, 2).cast(MONEY)
    if frozen:
        value = F.when(F.col("_closed"), F.coalesce(F.col(frozen), value)).otherwise(value)
    return (
        rated.withColumn("rate_used", used).withColumn("converted_amount", value)
        .withColumn("frozen", F.col("_closed")).drop("_closed", "_rate_day", "rate")
    )


def unconverted_report(converted: DataFrame, rates: DataFrame, key: str, source: str = "crm") -> DataFrame:
    """Rows without a converted value, and whether the currency has no rate at all or none that early."""
    known = (
        rates.filter(F.col("source") == source).select(F.col("currency").alias("_known")).distinct()
    )
    return (
        converted.filter(F.col("converted_amount").isNull())
        .join(known, F.col("currency") == F.col("_known"), "left")
        .select(
            key, "currency",
            F.when(F.col("currency").isNull(), "no currency")
            .when(F.col("_known").isNull(), "no rate for currency")
            .otherwise("no rate that early").alias("reason"),
        )
    )


def latest_rate(rates: DataFrame, as_of: str) -> DataFrame:
    known = rates.filter(F.col("effective_from") <= F.lit(as_of).cast("date"))
    return known.groupBy("currency", "source").agg(
        F.max("effective_from").alias("effective_from"), F.max_by("rate", "effective_from").alias("rate")
    )


def fx_staleness(rates: DataFrame, as_of: str, days: int = STALE_DAYS) -> DataFrame:
    newest = rates.groupBy("currency").agg(F.max("effective_from").alias("newest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("newest"))
    return newest.select("currency", age.alias("age_days"), (age > days).alias("stale"))


def fx_drift(rates: DataFrame, as_of: str, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Newest authoritative rate next to the newest market rate of the same currency."""
    newest = latest_rate(rates, as_of)
    both = newest.groupBy("currency").agg(
        F.max(F.when(F.col("source") == "crm", F.col("rate"))).alias("crm_rate"),
        F.max(F.when(F.col("source") == "market", F.col("rate"))).alias("market_rate"),
    )
    drift = F.try_divide((F.col("crm_rate") - F.col("market_rate")).cast("double"), F.col("market_rate").cast("double"))
    return both.select("currency", "crm_rate", "market_rate", drift.alias("drift"), (F.abs(drift) > limit).alias("beyond_limit"))


def currency_mix(converted: DataFrame) -> DataFrame:
    """Records per currency and how many of them could not be converted."""
    return converted.groupBy("currency").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("converted_amount").isNull()).alias("unconverted")
    )


def freeze_on_close(history: DataFrame, rates: DataFrame, source: str = "crm", base: str = "USD") -> DataFrame:
    """The converted value at the first closed state of each deal, fixed from then on."""
    order = F.struct("day", "line", "part_no", "supp_no", "close_date", "amount")
    first = (
        history.filter(F.col("stage").isin(*CLOSED_STAGES)).groupBy("opp_id")
        .agg(F.min("day").alias("closed_on"),
             F.min_by(F.struct("stage", "amount", "currency"), order).alias("_first"))
        .select("opp_id", "closed_on", "_first.*")
    )
    out = fx_convert(first, rates, "9999-12-31", base, source, close_day="closed_on")
    return out.select(
        "opp_id", "closed_on", F.col("stage").alias("closed_stage"), "currency",
        F.col("converted_amount").alias("frozen_amount"),
    )


def fx_volume_split(prev: DataFrame, cur: DataFrame, rates: DataFrame, prev_day: str, cur_day: str, source: str = "crm") -> DataFrame:
    """Split the change of the open book by currency into deal movement and rate movement."""
    def book(df: DataFrame, name: str) -> DataFrame:
        return df.filter("is_open").groupBy("currency").agg(F.sum("amount").cast(MONEY).alias(name))

    both = book(prev, "amount_before").join(book(cur, "amount_now"), "currency", "full")
    both = both.withColumn("_d0", F.lit(prev_day).cast("date")).withColumn("_d1", F.lit(cur_day).cast("date"))
    one = F.when(F.col("currency") == "USD", F.lit(1).cast(RATE))
    both = with_rate(both, rates, "_d0", source).withColumn("_r0", F.coalesce(one, "rate")).drop("rate")
    both = with_rate(both, rates, "_d1", source).withColumn("_r1", F.coalesce(one, "rate"))
    before, now = F.coalesce("amount_before", F.lit(0).cast(MONEY)), F.coalesce("amount_now", F.lit(0).cast(MONEY))
    return both.select(
        "currency",
        F.round((now - before).cast(MONEY) * F.col("_r0"), 2).cast(MONEY).alias("from_deals"),
        F.round(now * (F.col("_r1") - F.col("_r0")).cast(RATE), 2).cast(MONEY).alias("from_rates"),
    )
