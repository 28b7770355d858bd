"""Engagement: inbound above outbound, meetings highest, unknown direction never counted as silence."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import auto_reply_match

# Our defaults: points per class of event.
WEIGHTS = {"meeting": 5, "inbound": 3, "outbound": 1, "machine": 0}
WINDOW_DAYS = 14
HEATING, COOLING = 1.25, 0.75


def event_class() -> Column:
    """Class of an event; null when its direction cannot be told."""
    return (
        F.when(F.col("kind") == "meeting", "meeting")
        .when(auto_reply_match(F.col("subject")), "machine")
        .otherwise(F.col("direction"))
    )


def points(weights: Mapping[str, int] = WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.try_element_at(table, F.col("event_class"))


def classed(activity: DataFrame) -> DataFrame:
    return activity.filter(F.col("opp_id").isNotNull()).withColumn("event_class", event_class())


def engagement_score(activity: DataFrame, as_of: str, days: int = WINDOW_DAYS, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """Score of each deal over the window that ends on the day before `as_of`.

    A deal whose events all lack a direction is undetermined, not zero.
    """
    day = F.lit(as_of).cast("date")
    recent = classed(activity).filter((F.col("day") < day) & (F.col("day") >= F.date_sub(day, days)))
    return recent.groupBy("opp_id").agg(
        F.sum(points(weights)).alias("score"), F.count(F.lit(1)).alias("events"),
        F.when(F.count("event_class") == 0, "undetermined").otherwise("scored").alias("label"),
    )


def engagement_explain(activity: DataFrame, as_of: str, days: int = WINDOW_DAYS, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """The parts of each score: events and points by class."""
    day = F.lit(as_of).cast("date")
    recent = classed(activity).filter((F.col("day") < day) & (F.col("day") >= F.date_sub(day, days)))
    return (
        recent.groupBy("opp_id", F.coalesce("event_class", F.lit("unknown")).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(points(weights)), F.lit(0)).alias("points"))
    )


def engagement_trend(activity: DataFrame, as_of: str, days: int = WINDOW_DAYS, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """This window against the one before it; outbound alone never heats a deal."""
    day = F.lit(as_of).cast("date")
    seen = classed(activity).filter((F.col("day") < day) & (F.col("day") >= F.date_sub(day, 2 * days)))
    now = F.col("day") >= F.date_sub(day, days)
    answered = F.col("event_class").isin("inbound", "meeting")
    sums = seen.groupBy("opp_id").agg(
        F.coalesce(F.sum(F.when(now, points(weights))), F.lit(0)).alias("score"),
        F.coalesce(F.sum(F.when(~now, points(weights))), F.lit(0)).alias("prior_score"),
        F.count_if(now & answered).alias("answered"),
        F.count("event_class").alias("known"),
    )
    s, p = F.col("score"), F.col("prior_score")
    label = (
        F.when(F.col("known") == 0, "Undetermined")
        .when((F.col("answered") > 0) & (s >= p * HEATING), "Heating")
        .when((s <= p * COOLING) | (F.col("answered") == 0), "Cooling")
        .otherwise("Steady")
    )
    return sums.select("opp_id", "score", "prior_score", label.alias("trend"))


def deal_ranking(opps: DataFrame, trend: DataFrame) -> DataFrame:
    """Open new-business deals with a rank key from Heating to Cooling; renewals are left out."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(("Heating", "Steady", "Cooling", "Undetermined")) for x in (s, i)])
    live = opps.filter(F.col("is_open") & (F.col("track") == "new"))
    return (
        live.join(trend, "opp_id").withColumn("trend_rank", F.try_element_at(order, "trend"))
        .select("opp_id", "account", "trend_rank", "trend", "score")
        .orderBy("trend_rank", F.col("score").desc(), "opp_id")
    )


def book_temperature(activity: DataFrame, as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Deals heating and cooling in this window and in the one before."""
    def period(name: str, day: str) -> DataFrame:
        return engagement_trend(activity, day, days).agg(
            F.count_if(F.col("trend") == "Heating").alias("heating"), F.count_if(F.col("trend") == "Cooling").alias("cooling")
        ).select(F.lit(name).alias("period"), "heating", "cooling")

    before = (dt.date.fromisoformat(as_of) - dt.timedelta(days=days)).isoformat()
    return period("this", as_of).unionByName(period("last", before))


def response_rate_trend(activity: DataFrame, floor: int = 5) -> DataFrame:
    """Replies over outbound mail by week; thin weeks show counts only."""
    machine = auto_reply_match(F.col("subject"))
    weekly = activity.groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(
        F.count_if((F.col("direction") == "inbound") & ~machine).alias("replies"),
        F.count_if(F.col("direction") == "outbound").alias("sent"),
    )
    return weekly.withColumn("rate", F.when(F.col("sent") >= floor, F.try_divide(F.col("replies").cast("double"), F.col("sent").cast("double"))))
