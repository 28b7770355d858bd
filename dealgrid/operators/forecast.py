"""Forecast numbers by track: headline, goals, snapshots, movement and pacing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgrid.operators.sequences import ordered_history, top_per_key

MONEY = "decimal(18,2)"

# Chance of closing by open stage, in percent.
STAGE_CHANCE = {"Qualify": 10, "Discovery": 20, "Validate": 40, "Proposal": 60, "Negotiate": 80}

MATERIAL_SHARE = 0.1


def in_period(day: str, start: str, end: str) -> Column:
    return F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def total(amount: Column, cond: Column | None = None) -> Column:
    """Sum as decimal(18,2); zero when nothing qualifies."""
    picked = amount if cond is None else F.when(cond, amount)
    return F.coalesce(F.sum(picked), F.lit(0)).cast(MONEY)


def label_to_value(df: DataFrame, column: str, mapping: Mapping[str, str], name: str = "forecast_category") -> DataFrame:
    """Translate display labels to stored values before any filter; unknown labels stay as they are."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(name, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def stage_chance() -> Column:
    chance = F.create_map(*[F.lit(x) for pair in STAGE_CHANCE.items() for x in pair])
    return F.try_element_at(chance, F.col("stage"))


def pipeline_headline(
    opps: DataFrame, goals: DataFrame, start: str, end: str, by: Sequence[str] = ("track", "owner")
) -> DataFrame:
    """Commit, best case, weighted and won, next to the goal, for each group.

    Sums converted amounts only. Rows that could not be converted are counted, not added as zero.
    """
    amount, due = F.col("converted_amount"), in_period("close_date", start, end)
    live = F.col("is_open") & due
    won = (F.col("stage") == "Closed Won") & due
    position = opps.groupBy(*by).agg(
        total(amount, live & (F.col("forecast_category") == "Commit")).alias("commit_total"),
        total(amount, live & (F.col("forecast_category") == "BestCase")).alias("best_case"),
        F.coalesce(F.sum(F.when(live, amount * stage_chance())), F.lit(0)).cast("decimal(28,2)").alias("weighted_pct"),
        total(amount, won).alias("won"),
        total(amount, F.col("is_open")).alias("open_total"),
        F.count_if((live | won) & amount.isNull()).alias("unconverted"),
    )
    target = (
        goals.filter(F.col("period_start") == F.lit(start).cast("date")).groupBy(*by)
        .agg(F.sum("converted_target").cast(MONEY).alias("target"))
    )
    for col in by:
        target = target.withColumnRenamed(col, f"_{col}")
    same = None
    for col in by:
        match = F.col(col).eqNullSafe(F.col(f"_{col}"))
        same = match if same is None else same & match
    joined = position.join(target, same, "left")
    gap = F.col("target") - F.col("won")
    return joined.select(
        *by, "commit_total", "best_case", (F.col("weighted_pct").cast("double") / 100).alias("weighted"), "won",
        "unconverted", "target", gap.cast(MONEY).alias("gap"),
        F.when(gap > 0, F.try_divide(F.col("open_total").cast("double"), gap.cast("double"))).alias("coverage"),
    )


def track_gate(opps: DataFrame, renewals: DataFrame, enabled: Sequence[str], start: str, end: str) -> DataFrame:
    """Which tracks belong in the forecast of the period, and why."""
    new = opps.agg(F.count(F.lit(1)).alias("n")).select(F.lit("new").alias("track"), "n")
    due = renewals.filter(in_period("contract_end", start, end))
    renewal = due.agg(F.count(F.lit(1)).alias("n")).select(F.lit("renewal").alias("track"), "n")
    partner = opps.agg(F.count("partner_id").alias("n")).select(F.lit("partner").alias("track"), "n")
    on = F.col("track").isin(*enabled)
    return new.unionByName(renewal).unionByName(partner).select(
        "track",
        ((F.col("track") == "new") | (on & (F.col("n") > 0))).alias("included"),
        F.when(F.col("track") == "new", "always").when(~on, "module off")
        .when(F.col("n") == 0, "nothing in the period").otherwise("in use").alias("reason"),
    )


def track_split(cur: DataFrame, prior: DataFrame) -> DataFrame:
    """Open totals per track, never added up; opposite movement of two tracks is flagged."""
    def position(df: DataFrame, name: str) -> DataFrame:
        return df.filter("is_open").groupBy("track").agg(total(F.col("converted_amount")).alias(name))

    both = position(cur, "now").join(position(prior, "before"), "track", "full")
    zero = F.lit(0).cast(MONEY)
    moved = both.withColumn("moved", (F.coalesce("now", zero) - F.coalesce("before", zero)).cast(MONEY))
    apart = moved.agg(((F.max("moved") > 0) & (F.min("moved") < 0)).alias("opposite"))
    return moved.select("track", "now", "before", "moved", apart.scalar().alias("opposite"))


def owner_breakdown(opps: DataFrame) -> DataFrame:
    """Deals and converted totals by rep; deals without an owner are a group of their own."""
    return opps.filter("is_open").groupBy("owner").agg(
        F.count(F.lit(1)).alias("deals"), total(F.col("converted_amount")).alias("open_total")
    )


def owner_concentration(opps: DataFrame, activity: DataFrame, roster: DataFrame, as_of: str) -> DataFrame:
    """Per rep: share of the open number in the top two deals, no new deals this month, no activity this week."""
    day = F.lit(as_of).cast("date")
    live = opps.filter(F.col("is_open") & F.col("owner").isNotNull() & F.col("converted_amount").isNotNull())
    book = live.groupBy("owner").agg(F.sum("converted_amount").cast(MONEY).alias("book"))
    top = (
        top_per_key(live.select("owner", "opp_id", "converted_amount"), ["owner"],
                    [F.col("converted_amount").desc(), F.col("opp_id")], 2)
        .groupBy("owner").agg(F.sum("converted_amount").cast(MONEY).alias("top_two"))
    )
    fresh = opps.groupBy("owner").agg(F.max("created").alias("newest"))
    busy = activity.groupBy(F.col("actor").alias("owner")).agg(F.max("day").alias("last_day"))
    out = roster.select(F.col("rep").cast("long").alias("owner"))
    for side in (book, top, fresh, busy):
        out = out.join(side, "owner", "left")
    return out.select(
        "owner", "book", F.try_divide(F.col("top_two").cast("double"), F.col("book").cast("double")).alias("top_two_share"),
        (F.col("newest").isNull() | (F.col("newest") < F.date_sub(day, 30))).alias("no_new_pipeline"),
        (F.col("last_day").isNull() | (F.col("last_day") < F.date_sub(day, 7))).alias("no_activity"),
    )


def goal_attainment(opps: DataFrame, goals: DataFrame, start: str, end: str) -> DataFrame:
    """Won converted amount against each goal of the period, by owner and track."""
    won = (
        opps.filter((F.col("stage") == "Closed Won") & in_period("close_date", start, end))
        .groupBy(F.col("owner").alias("_owner"), F.col("track").alias("_track"))
        .agg(total(F.col("converted_amount")).alias("actual"))
    )
    wanted = goals.filter(F.col("period_start") == F.lit(start).cast("date"))
    joined = wanted.join(won, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("track") == F.col("_track")), "left")
    actual = F.coalesce("actual", F.lit(0).cast(MONEY))
    return joined.select(
        "owner", "track", actual.alias("actual"), F.col("converted_target").alias("target"),
        F.try_divide(actual.cast("double"), F.col("converted_target").cast("double")).alias("attained"),
        (F.col("converted_target") - actual).cast(MONEY).alias("gap"),
    )


def goal_freshness(goals: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """Goals not confirmed within their cadence; a goal never confirmed is stale."""
    due = F.add_months(F.col("last_confirmed"), months)
    stale = F.col("last_confirmed").isNull() | (due < F.lit(as_of).cast("date"))
    return goals.select("owner", "track", "period_start", due.alias("confirm_by"), stale.alias("stale"))


def goal_history(revisions: DataFrame) -> DataFrame:
    """Every version of a goal with its span; a replaced one is Superseded and keeps its target."""
    seq = ordered_history(
        revisions, ["owner", "track"], ["period_start", "goal_id"], F.col("period_start"),
        prev={"original_target": "target"}, following={"valid_to": "period_start"}, number="version",
    )
    return seq.select(
        "owner", "track", "version", F.col("period_start").alias("valid_from"), "valid_to", "target", "original_target",
        F.when(F.col("valid_to").isNull(), "Active").otherwise("Superseded").alias("status"),
    )


def prior_snapshot(snapshots: DataFrame) -> DataFrame:
    """Each snapshot next to the one before it of the same cadence; the first of a cadence says so.

    Snapshots are one row per cadence and date, so a window by cadence stays small.
    """
    w = Window.partitionBy("cadence").orderBy("taken_at")
    prior = F.lag("commit_total").over(w)
    return snapshots.select(
        "cadence", "taken_at", "commit_total", F.lag("taken_at").over(w).alias("prior_taken_at"),
        (F.col("commit_total") - prior).cast(MONEY).alias("moved"), prior.isNull().alias("first_of_cadence"),
    )


def forecast_accuracy(snapshots: DataFrame, opps: DataFrame, cadence: str = "weekly") -> DataFrame:
    """What the first snapshot of each quarter committed against what closed in it."""
    quarter = F.date_trunc("quarter", "taken_at").cast("date").alias("quarter")
    first = (
        snapshots.filter(F.col("cadence") == cadence).groupBy(quarter)
        .agg(F.min_by("commit_total", "taken_at").cast(MONEY).alias("committed"))
    )
    closed = (
        opps.filter(F.col("stage") == "Closed Won")
        .groupBy(F.date_trunc("quarter", "close_date").cast("date").alias("quarter"))
        .agg(total(F.col("amount")).alias("closed"))
    )
    ratio = F.try_divide(F.col("closed").cast("double"), F.col("committed").cast("double"))
    return first.join(closed, "quarter", "left").select("quarter", "committed", "closed", ratio.alias("closed_share"))


def pacing(opps: DataFrame, goals: DataFrame, start: str, end: str) -> DataFrame:
    """Running won total of the period, by day, against the goal of each owner and track.

    Deals fold to one row per owner, track and day first: the running sum sees days, not deals.
    """
    won = opps.filter((F.col("stage") == "Closed Won") & in_period("close_date", start, end) & F.col("owner").isNotNull())
    daily = won.groupBy("owner", "track", "close_date").agg(total(F.col("converted_amount")).alias("day_total"))
    w = Window.partitionBy("owner", "track").orderBy("close_date").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumn("running", F.sum("day_total").over(w).cast(MONEY))
    target = goals.filter(F.col("period_start") == F.lit(start).cast("date")).select("owner", "track", "converted_target")
    share = F.try_divide(F.col("running").cast("double"), F.col("converted_target").cast("double"))
    return run.join(target, ["owner", "track"], "left").select(
        "owner", "track", F.col("close_date").alias("day"), "running", share.alias("of_goal")
    )


def material_alerts(cur: DataFrame, prior: DataFrame, share: float = MATERIAL_SHARE) -> DataFrame:
    """Quarters and years whose open total moved by a large share, with the track."""
    def position(df: DataFrame, name: str) -> DataFrame:
        year = F.date_trunc("year", "close_date").cast("date")
        quarter = F.date_trunc("quarter", "close_date").cast("date")
        return (
            df.groupBy("track", quarter.alias("_q"), year.alias("_y")).agg(total(F.col("amount")).alias("_sum"))
            .withColumn("_level", F.explode(F.array(
                F.struct(F.lit("quarter").alias("level"), F.col("_q").alias("period")),
                F.struct(F.lit("year").alias("level"), F.col("_y").alias("period")))))
            .groupBy("track", "_level.level", "_level.period").agg(F.sum("_sum").cast(MONEY).alias(name))
        )

    both = position(cur, "now").join(position(prior, "before"), ["track", "level", "period"])
    moved = F.try_divide((F.col("now") - F.col("before")).cast("double"), F.col("before").cast("double"))
    return both.withColumn("moved_share", moved).filter(F.abs("moved_share") >= share)


def closest_gap_closer(opps: DataFrame, gap: DataFrame) -> DataFrame:
    """Open deals of a track whose converted amount alone closes the gap of that track."""
    need = gap.filter(F.col("gap") > 0).select(F.col("track").alias("_track"), F.col("gap"))
    return (
        opps.filter("is_open").join(need, (F.col("track") == F.col("_track")) & (F.col("converted_amount") >= F.col("gap")))
        .select("track", "opp_id", "converted_amount", "gap", (F.col("converted_amount") - F.col("gap")).cast(MONEY).alias("spare"))
    )


def pipeline_movement(prev: DataFrame, cur: DataFrame, stage_order: Sequence[str]) -> DataFrame:
    """Class of every deal seen in either snapshot, with the amount it moved."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(stage_order) for x in (s, i)])
    cols = ["amount", "stage", "close_date", "is_open"]
    p = prev.select("opp_id", *[F.col(c).alias(f"p_{c}") for c in cols])
    c = cur.select("opp_id", *[F.col(x).alias(f"c_{x}") for x in cols])
    both = p.join(c, "opp_id", "full")
    rank_p, rank_c = F.try_element_at(ranks, "p_stage"), F.try_element_at(ranks, "c_stage")
    kind = (
        F.when(F.col("p_stage").isNull(), "new").when(F.col("c_stage").isNull(), "dropped")
        .when(F.col("p_is_open") & ~F.col("c_is_open"), "closed")
        .when(F.col("c_close_date") > F.col("p_close_date"), "slipped")
        .when(rank_c > rank_p, "advanced").when(rank_c < rank_p, "moved back").otherwise("unchanged")
    )
    zero = F.lit(0).cast(MONEY)
    moved = F.coalesce("c_amount", zero) - F.coalesce("p_amount", zero)
    return both.select("opp_id", kind.alias("movement"), moved.cast(MONEY).alias("amount_moved"))


def stage_conversion(history: DataFrame, stage_order: Sequence[str], segments: DataFrame | None = None) -> DataFrame:
    """By quarter of first sight: deals that reached each stage or one beyond it, the share that went on, and the cohort's win rate.

    With `segments` (opp_id, segment) each cohort is shown as a whole, under the segment `all`, and by segment; deals without one are `unknown`.
    """
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(stage_order) for x in (s, i)])
    open_stages = [s for s in stage_order if not s.startswith("Closed")] + ["Closed Won"]
    reach = history.withColumn("_rank", F.when(F.col("stage") != "Closed Lost", F.try_element_at(ranks, "stage")))
    per_deal = reach.groupBy("opp_id").agg(
        F.min("day").alias("first_day"), F.max("_rank").alias("top"), F.bool_or(F.col("stage") == "Closed Won").alias("won"),
        F.bool_or(F.col("stage").startswith("Closed")).alias("decided"))
    placed = per_deal.withColumn("cohort", F.date_trunc("quarter", "first_day").cast("date"))
    if segments is None:
        placed = placed.withColumn("segment", F.lit("all"))
    else:
        own = placed.join(segments.select("opp_id", "segment"), "opp_id", "left").withColumn("segment", F.coalesce("segment", F.lit("unknown")))
        placed = own.withColumn("segment", F.explode(F.array(F.lit("all"), F.col("segment"))))
    counts = placed.groupBy("cohort", "segment").agg(
        *[F.count_if(F.col("top") >= i).alias(f"n{i}") for i in range(len(open_stages))],
        F.count_if("won").alias("won"), F.count_if("decided").alias("decided"),
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"n{i}").alias("reached"),
                 (F.col(f"n{i + 1}") if i + 1 < len(open_stages) else F.lit(None).cast("long")).alias("went_on"))
        for i, s in enumerate(open_stages)
    ]))
    return counts.select("cohort", "segment", "won", "decided", rows.alias("r")).select(
        "cohort", "segment", "r.stage", "r.reached", F.try_divide(F.col("r.went_on").cast("double"), F.col("r.reached").cast("double")).alias("conversion"),
        "decided", F.try_divide(F.col("won").cast("double"), F.col("decided").cast("double")).alias("win_rate")
    )


def cadence_activity(activity: DataFrame, quotes: DataFrame, history: DataFrame, cadence: str) -> DataFrame:
    """Meetings, replies, quotes sent and stage entries per period.

    A quarter or a year leaves the operational counts out.
    """
    if cadence not in ("week", "month", "quarter", "year"):
        raise ValueError(f"unknown cadence {cadence!r}")

    def period(day: str) -> Column:
        return F.date_trunc(cadence, F.col(day)).cast("date").alias("period")

    a = activity.groupBy(period("day")).agg(
        F.count_if(F.col("kind") == "meeting").alias("meetings"), F.count_if(F.col("kind") == "reply").alias("replies")
    )
    q = quotes.filter(F.col("sent_date").isNotNull()).groupBy(period("sent_date")).agg(F.count(F.lit(1)).alias("quotes_sent"))
    h = history.groupBy(period("day")).agg(F.count(F.lit(1)).alias("stage_moves"))
    out = a.join(q, "period", "full").join(h, "period", "full").na.fill(0)
    return out if cadence in ("week", "month") else out.select("period", "stage_moves")
