"""Forecast and engagement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import engagement, forecast, fx
from dealgrid.plans.common import CATEGORY_VALUES, QUARTER, STAGES, converted, converted_goals
from dealgrid.plans.registry import query
from dealgrid.plans.views import AS_OF

CHANCE = "case stage when 'Qualify' then 10 when 'Discovery' then 20 when 'Validate' then 40 when 'Proposal' then 60 when 'Negotiate' then 80 end"
DUE = "close_date between date '2001-07-01' and date '2001-09-30'"
RANK = "case {c} when 'Qualify' then 0 when 'Discovery' then 1 when 'Validate' then 2 when 'Proposal' then 3 when 'Negotiate' then 4 when 'Closed Won' then 5 when 'Closed Lost' then 6 end"


def stage_rank_sql(column: str) -> str:
    return RANK.replace("{c}", column)


@query("forecast_headline", f"""
with p as (
  select track, owner, coalesce(sum(converted_amount) filter (is_open and {DUE} and forecast_category = 'Commit'), 0)::decimal(18,2) as commit_total,
    coalesce(sum(converted_amount) filter (is_open and {DUE} and forecast_category = 'BestCase'), 0)::decimal(18,2) as best_case,
    coalesce(sum(converted_amount * {CHANCE}) filter (is_open and {DUE}), 0)::decimal(28,2) as weighted_pct,
    coalesce(sum(converted_amount) filter (stage = 'Closed Won' and {DUE}), 0)::decimal(18,2) as won,
    coalesce(sum(converted_amount) filter (is_open), 0)::decimal(18,2) as open_total,
    count(*) filter ((is_open or stage = 'Closed Won') and {DUE} and converted_amount is null) as unconverted
  from o_conv group by 1, 2),
g as (select track, owner, sum(converted_target)::decimal(18,2) as target from o_goals where period_start = date '2001-07-01' group by 1, 2)
select p.track, p.owner, commit_total::double as commit_total, best_case::double as best_case, weighted_pct::double / 100 as weighted, won::double as won,
  unconverted, target::double as target, (target - won)::double as gap,
  case when target - won > 0 then open_total::double / (target - won)::double end as coverage
from p left join g on p.track = g.track and p.owner is not distinct from g.owner""")
def _(t):
    return forecast.pipeline_headline(converted(t), converted_goals(t), *QUARTER)


@query("label_to_value", "select forecast_category, count(*) as deals from o_conv group by 1")
def _(t):
    out = forecast.label_to_value(t.opportunities, "forecast_label", CATEGORY_VALUES)
    return out.groupBy("forecast_category").agg(F.count(F.lit(1)).alias("deals"))


@query("track_gate", """
select 'new' as track, true as included, 'always' as reason
union all select 'renewal', count(*) > 0, case when count(*) = 0 then 'nothing in the period' else 'in use' end from renewals
  where contract_end between date '2001-07-01' and date '2001-09-30'
union all select 'partner', false, 'module off' from (select count(*) from opportunities)""")
def _(t):
    return forecast.track_gate(t.opps_tracked, t.renewals, ["new", "renewal"], *QUARTER)


@query("track_split", """
with c as (select track, sum(converted_amount)::decimal(18,2) as now from o_conv where is_open group by 1),
b as (select track, sum(converted_amount)::decimal(18,2) as before from o_conv where is_open and created < date '2001-01-01' group by 1),
m as (select coalesce(c.track, b.track) as track, now, before, coalesce(now, 0) - coalesce(before, 0) as moved from c full join b on c.track = b.track)
select track, now::double as now, before::double as before, moved::double as moved, (select max(moved) > 0 and min(moved) < 0 from m) as opposite from m""")
def _(t):
    cur = converted(t)
    return forecast.track_split(cur, cur.filter(F.col("created") < F.lit("2001-01-01").cast("date")))


@query("owner_breakdown", """
select owner, count(*) as deals, coalesce(sum(converted_amount), 0)::decimal(18,2)::double as open_total from o_conv where is_open group by 1""")
def _(t):
    return forecast.owner_breakdown(converted(t))


@query("owner_concentration", """
with live as (select * from o_conv where is_open and owner is not null and converted_amount is not null),
book as (select owner, sum(converted_amount) as book from live group by 1),
top as (select owner, sum(converted_amount) as top_two from (select *, row_number() over (partition by owner order by converted_amount desc, opp_id) as rn from live) where rn <= 2 group by 1),
fresh as (select owner, max(created) as newest from o_conv group by 1),
busy as (select actor as owner, max(day) as last_day from activity group by 1)
select rep::bigint as owner, book::double as book, top_two::double / book::double as top_two_share,
  newest is null or newest < date '2001-08-02' - 30 as no_new_pipeline, last_day is null or last_day < date '2001-08-02' - 7 as no_activity
from team left join book on rep = book.owner left join top on rep = top.owner left join fresh on rep = fresh.owner left join busy on rep = busy.owner""")
def _(t):
    return forecast.owner_concentration(converted(t), t.activity, t.team, AS_OF)


@query("goal_attainment", f"""
with w as (select owner, track, sum(converted_amount)::decimal(18,2) as actual from o_conv where stage = 'Closed Won' and {DUE} group by 1, 2)
select g.owner, g.track, coalesce(actual, 0)::double as actual, converted_target::double as target,
  coalesce(actual, 0)::double / converted_target::double as attained, (converted_target - coalesce(actual, 0))::double as gap
from o_goals g left join w on g.track = w.track and g.owner is not distinct from w.owner where period_start = date '2001-07-01'""")
def _(t):
    return forecast.goal_attainment(converted(t), converted_goals(t), *QUARTER)


@query("goal_freshness", """
select owner, track, period_start::varchar as period_start, (last_confirmed + to_months(3))::date::varchar as confirm_by,
  (last_confirmed + to_months(3))::date < date '2001-08-02' as stale from goals""")
def _(t):
    return forecast.goal_freshness(t.goals, AS_OF)


@query("goal_history", """
select owner, track, row_number() over w as version, period_start::varchar as valid_from, (lead(period_start) over w)::varchar as valid_to,
  target::double as target, (lag(target) over w)::double as original_target,
  case when lead(period_start) over w is null then 'Active' else 'Superseded' end as status
from goals where owner is not null window w as (partition by owner, track order by period_start)""")
def _(t):
    revisions = t.goals.filter("owner is not null").withColumn("goal_id", F.concat_ws("-", "owner", "track", "period_start"))
    return forecast.goal_history(revisions)


@query("prior_snapshot", """
select cadence, taken_at::varchar as taken_at, commit_total::double as commit_total, (lag(taken_at) over w)::varchar as prior_taken_at,
  (commit_total - lag(commit_total) over w)::decimal(18,2)::double as moved, lag(commit_total) over w is null as first_of_cadence
from snapshots window w as (partition by cadence order by taken_at)""")
def _(t):
    return forecast.prior_snapshot(t.snapshots)


@query("forecast_accuracy", """
with f as (select date_trunc('quarter', taken_at)::date as quarter, min_by(commit_total, taken_at) as committed from snapshots where cadence = 'weekly' group by 1),
c as (select date_trunc('quarter', close_date)::date as quarter, sum(amount) as closed from opportunities where stage = 'Closed Won' group by 1)
select f.quarter::varchar as quarter, committed::double as committed, closed::double as closed, closed::double / committed::double as closed_share
from f left join c on f.quarter = c.quarter""")
def _(t):
    return forecast.forecast_accuracy(t.snapshots, t.opportunities)


@query("pacing", """
with d as (select owner, track, close_date, sum(converted_amount) as day_total from o_conv
  where stage = 'Closed Won' and close_date between date '2001-07-01' and date '2001-09-30' and owner is not null group by 1, 2, 3),
r as (select owner, track, close_date, sum(coalesce(day_total, 0)) over (partition by owner, track order by close_date) as running from d)
select r.owner, r.track, close_date::varchar as day, running::double as running, running::double / converted_target::double as of_goal
from r left join o_goals g on r.owner = g.owner and r.track = g.track and g.period_start = date '2001-07-01'""")
def _(t):
    return forecast.pacing(converted(t), converted_goals(t), *QUARTER)


@query("material_alerts", """
with c as (select o.track, x.close_date, x.amount from opp_cur x join opps_tracked o on x.opp_id = o.opp_id),
p as (select o.track, x.close_date, x.amount from opp_prev x join opps_tracked o on x.opp_id = o.opp_id),
ca as (select track, 'quarter' as level, date_trunc('quarter', close_date)::date as period, sum(amount) as now from c group by 1, 2, 3
  union all select track, 'year', date_trunc('year', close_date)::date, sum(amount) from c group by 1, 2, 3),
pa as (select track, 'quarter' as level, date_trunc('quarter', close_date)::date as period, sum(amount) as before from p group by 1, 2, 3
  union all select track, 'year', date_trunc('year', close_date)::date, sum(amount) from p group by 1, 2, 3)
select ca.track, ca.level, ca.period::varchar as period, now::double as now, before::double as before, (now - before)::double / before::double as moved_share
from ca join pa on ca.track = pa.track and ca.level = pa.level and ca.period = pa.period
where abs((now - before)::double / before::double) >= 0.1""")
def _(t):
    track = t.opps_tracked.select("opp_id", "track")
    return forecast.material_alerts(t.opp_cur.join(track, "opp_id"), t.opp_prev.join(track, "opp_id"))


@query("closest_gap_closer", """
with g as (select track, (max(converted_amount) * 0.95)::decimal(18,2) as gap from o_conv where is_open group by 1)
select o.track, opp_id, converted_amount::double as converted_amount, gap::double as gap, (converted_amount - gap)::double as spare
from o_conv o join g on o.track = g.track and converted_amount >= gap where is_open""")
def _(t):
    opps = converted(t)
    share = F.lit(0.95).cast("decimal(3,2)")
    gap = opps.filter("is_open").groupBy("track").agg((F.max("converted_amount") * share).cast("decimal(18,2)").alias("gap"))
    return forecast.closest_gap_closer(opps, gap)


@query("book_movement", f"""
select coalesce(p.opp_id, c.opp_id) as opp_id,
  case when p.opp_id is null then 'new' when c.opp_id is null then 'dropped' when p.is_open and not c.is_open then 'closed'
    when c.close_date > p.close_date then 'slipped' when {stage_rank_sql('c.stage')} > {stage_rank_sql('p.stage')} then 'advanced'
    when {stage_rank_sql('c.stage')} < {stage_rank_sql('p.stage')} then 'moved back' else 'unchanged' end as movement,
  (coalesce(c.amount, 0) - coalesce(p.amount, 0))::double as amount_moved
from opp_prev p full join opp_cur c on p.opp_id = c.opp_id""")
def _(t):
    return forecast.pipeline_movement(t.opp_prev, t.opp_cur, STAGES)


@query("stage_conversion", f"""
with d as (select opp_id, min(day) as first_day, max(case when stage <> 'Closed Lost' then {stage_rank_sql('stage')} end) as top,
  bool_or(stage = 'Closed Won') as won, bool_or(stage like 'Closed%') as decided from opp_history group by 1),
k as (select s, i from (values ('Qualify', 0), ('Discovery', 1), ('Validate', 2), ('Proposal', 3), ('Negotiate', 4), ('Closed Won', 5)) as k(s, i)),
g as (select d.*, unnest(['all', coalesce(segment, 'unknown')]) as segment from d left join opportunities using (opp_id) left join accounts using (account)),
c as (select date_trunc('quarter', first_day)::date as cohort, segment, s, i, count(*) filter (top >= i) as reached, count(*) filter (top >= i + 1) as went_on, count(*) filter (won) as won, count(*) filter (decided) as decided from g, k group by 1, 2, 3, 4)
select cohort::varchar as cohort, segment, s as stage, reached, case when i < 5 and reached > 0 then went_on::double / reached::double end as conversion,
  decided, case when decided > 0 then won::double / decided::double end as win_rate from c""")
def _(t):
    return forecast.stage_conversion(t.opp_history, STAGES, t.opportunities.select("opp_id", "account").join(t.accounts.select("account", "segment"), "account"))


@query("cadence_activity", """
with a as (select date_trunc('week', day)::date as period, count(*) filter (kind = 'meeting') as meetings, count(*) filter (kind = 'reply') as replies from raw_activity group by 1),
q as (select date_trunc('week', sent_date)::date as period, count(*) as quotes_sent from quotes where sent_date is not null group by 1),
h as (select date_trunc('week', day)::date as period, count(*) as stage_moves from opp_history group by 1),
k as (select period from a union select period from q union select period from h)
select k.period::varchar as period, coalesce(meetings, 0) as meetings, coalesce(replies, 0) as replies, coalesce(quotes_sent, 0) as quotes_sent, coalesce(stage_moves, 0) as stage_moves
from k left join a on a.period = k.period left join q on q.period = k.period left join h on h.period = k.period""")
def _(t):
    return forecast.cadence_activity(t.raw_activity, t.quotes, t.opp_history, "week")


@query("engagement_score", """
select opp_id, sum(pts)::bigint as score, count(*) as events, case when count(cls) = 0 then 'undetermined' else 'scored' end as label
from o_classed where day < date '2001-08-02' and day >= date '2001-08-02' - 14 group by 1""")
def _(t):
    return engagement.engagement_score(t.activity, AS_OF)


@query("engagement_explain", """
select opp_id, coalesce(cls, 'unknown') as part, count(*) as n, coalesce(sum(pts), 0)::bigint as points
from o_classed where day < date '2001-08-02' and day >= date '2001-08-02' - 14 group by 1, 2""")
def _(t):
    return engagement.engagement_explain(t.activity, AS_OF)


@query("engagement_trend", "select opp_id, score, prior_score, trend from o_trend_label")
def _(t):
    return engagement.engagement_trend(t.activity, AS_OF)


@query("deal_ranking", """
select o.opp_id, account, case trend when 'Heating' then 0 when 'Steady' then 1 when 'Cooling' then 2 else 3 end::bigint as trend_rank, trend, score
from opps_tracked o join o_trend_label t on o.opp_id = t.opp_id where is_open and track = 'new'
union all select 0, 0, 0, '', 0 where false""")
def _(t):
    return engagement.deal_ranking(t.opps_tracked, engagement.engagement_trend(t.activity, AS_OF))


@query("book_temperature", """
with w as (
  select p.period, opp_id, coalesce(sum(pts) filter (day >= p.d - 14), 0) as s, coalesce(sum(pts) filter (day < p.d - 14), 0) as pr,
    count(*) filter (day >= p.d - 14 and cls in ('inbound', 'meeting')) as answered, count(cls) as known
  from o_classed, (values ('this', date '2001-08-02'), ('last', date '2001-07-19')) as p(period, d) where day < p.d and day >= p.d - 28 group by 1, 2)
select period, count(*) filter (known > 0 and answered > 0 and s >= pr * 1.25) as heating,
  count(*) filter (known > 0 and not (answered > 0 and s >= pr * 1.25) and (s <= pr * 0.75 or answered = 0)) as cooling from w group by 1""")
def _(t):
    return engagement.book_temperature(t.activity, AS_OF)


@query("response_rate_trend", """
select date_trunc('week', day)::date::varchar as week, count(*) filter (direction = 'inbound' and subject not like 'Automatic reply%') as replies,
  count(*) filter (direction = 'outbound') as sent,
  case when count(*) filter (direction = 'outbound') >= 5 then count(*) filter (direction = 'inbound' and subject not like 'Automatic reply%')::double / count(*) filter (direction = 'outbound') end as rate
from raw_activity group by 1""")
def _(t):
    return engagement.response_rate_trend(t.raw_activity)
