"""Meeting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import competitors as cp, deals, engagement, meetings as mt
from dealgrid.plans.common import STAGES
from dealgrid.plans.q_deals import meetings_with_deal
from dealgrid.plans.q_forecast import stage_rank_sql
from dealgrid.plans.q_scalars import norm_host_sql
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF
from dealgrid.session import cut_lineage


def calendar(t: Tables):
    return t.sql("select c.*, l.open_opp as opp_id from calendar c left join latest_open l on c.account = l.open_account")


@query("meeting_match", f"""
with d as (select account, count(*) filter (is_open) as n, min(opp_id) filter (is_open) as opp, bool_or(stage = 'Closed Won') as customer from opportunities group by 1),
r as (select account, count(*) as n, min(renewal_id) as ren from renewals where status = 'Active' group by 1),
p as (select {norm_host_sql('email')} as dom, count(*) as n, min(lead_id) as lead from leads where email is not null group by 1),
j as (select m.meeting_id, m.about_contract, a.account, coalesce(d.n, 0) as open_deals, coalesce(r.n, 0) as contracts, coalesce(p.n, 0) as leads, opp, ren, lead, coalesce(customer, false) as customer
  from meetings m left join accounts a on m.account = a.account left join d on a.account = d.account left join r on a.account = r.account left join p on p.dom = {norm_host_sql('m.attendee')}),
k as (select *, case when about_contract and contracts = 1 then 'renewal' when open_deals = 1 then 'opportunity' when open_deals + contracts = 0 and customer then 'customer'
  when open_deals + contracts = 0 and leads = 1 then 'lead' end as related_type from j)
select meeting_id, case when related_type is not null then 'linked' when open_deals + contracts + leads = 0 then 'no match' else 'review' end as status, related_type,
  case related_type when 'renewal' then ren when 'opportunity' then opp when 'customer' then account when 'lead' then lead end as related_id, open_deals, contracts, leads from k""")
def _(t):
    return mt.meeting_match(t.meetings, t.accounts, t.opportunities, t.renewals, t.leads)


@query("meeting_credit", """
with m as (select m.meeting_id, m.day, m.attendee, l.open_opp as opp_id from meetings m left join latest_open l on m.account = l.open_account
  union all select activity_id + 1000000, day, email, opp_id from activity where kind = 'meeting' and feed = 'crm')
select meeting_id, day::varchar as day, attendee, opp_id, case when exists (select 1 from activity a where a.kind = 'meeting' and a.day = m.day and a.email = m.attendee and a.opp_id = m.opp_id) then 'already-on-calendar' else 'ingested' end as engagement_ingested from m""")
def _(t):
    held = meetings_with_deal(t).select("meeting_id", "day", "attendee", "opp_id")
    typed = t.activity.filter("kind = 'meeting' and feed = 'crm'").select(
        (F.col("activity_id") + 1000000).alias("meeting_id"), "day", F.col("email").alias("attendee"), "opp_id")
    return mt.meeting_credit(held.unionByName(typed), t.activity)


@query("activity_union", """
select day::varchar as day, kind, email, opp_id, min(activity_id) as activity_id, count(*) as copies from (
  select day, kind, email, opp_id, activity_id from activity union all select day, kind, email, opp_id, activity_id + 5000000 from activity where feed = 'calendar') group by 1, 2, 3, 4""")
def _(t):
    cols = ["day", "kind", "email", "opp_id", "activity_id"]
    feeds = {f: t.activity.filter(F.col("feed") == f).select(*cols) for f in ("mail", "calendar", "crm")}
    copies = feeds["calendar"].withColumn("activity_id", F.col("activity_id") + 5000000)
    return mt.activity_union(feeds["mail"], feeds["calendar"], feeds["crm"].unionByName(copies))


@query("last_meeting", """
with j as (select c.meeting_id, c.account, c.day, m.meeting_id as mid, m.day as mday, m.outcome, m.sentiment, row_number() over (partition by c.meeting_id order by m.day desc, m.meeting_id desc) as rn
  from calendar c left join meetings m on c.account = m.account and m.day < c.day)
select meeting_id, account, day::varchar as day, mid as last_meeting_id, mday::varchar as last_day, outcome as last_outcome, sentiment as last_sentiment from j where rn = 1""")
def _(t):
    return mt.last_meeting(t.calendar, t.meetings)


@query("open_commitments", """
select commitment_id, account, direction, due::varchar as due, greatest(date '2001-08-02' - due, 0)::bigint as days_late,
  case when direction = 'ours' and due < date '2001-08-02' then 1 when due < date '2001-08-02' then 2 when direction = 'ours' then 3 else 4 end::bigint as rank from commitments where status = 'Open'""")
def _(t):
    return mt.open_commitments(t.commitments, AS_OF)


@query("commitments_overdue", """
select direction, case when direction = 'theirs' then account else owner end as who, count(*) as overdue, max(date '2001-08-02' - due)::bigint as worst_days from commitments where status = 'Open' and due < date '2001-08-02' group by 1, 2""")
def _(t):
    return mt.commitments_overdue(t.commitments, AS_OF)


@query("new_attendees", """
select meeting_id, l.open_opp as opp_id, attendee from calendar c join latest_open l on c.account = l.open_account where not exists (select 1 from o_contacts p where p.opp_id = l.open_opp and p.email = c.attendee)""")
def _(t):
    return mt.new_attendees(calendar(t), deals.contacts_build(t.contact_roles, t.activity))


@query("unowned_meetings", """
with a as (select distinct actor as owner, day + 1 as day from raw_activity where event_type = 'error' and person = 5)
select meeting_id, c.day::varchar as day, c.owner, case when c.owner is null then 'no owner' when c.owner not in (select rep from team) then 'not on the roster' else 'rep is out' end as why
from calendar c where c.owner is null or c.owner not in (select rep from team) or exists (select 1 from a where a.owner = c.owner and a.day = c.day)""")
def _(t):
    out = t.raw_activity.filter("event_type = 'error' and person = 5").select(F.col("actor").alias("owner"), F.date_add("day", 1).alias("day"))
    return mt.unowned_meetings(t.calendar, t.team, out)


@query("meeting_prep", f"""
with c as (select c.*, l.open_opp as opp_id from calendar c left join latest_open l on c.account = l.open_account where c.day = date '2001-08-02'),
n as (select related_account as account, count(*) as news, arg_min(signal_id, row(-(event_date - date '1970-01-01'), signal_id)) as latest_news
  from signals where related_account is not null and event_date between date '2001-07-03' and date '2001-08-02' group by 1),
b as (select c.meeting_id, m.meeting_id as mid, m.day, m.outcome, m.sentiment from c left join meetings m on c.account = m.account and m.day < c.day qualify row_number() over (partition by c.meeting_id order by m.day desc, m.meeting_id desc) = 1)
select c.meeting_id, c.account, c.opp_id, o.stage, o.amount::double as amount, o.close_date::varchar as close_date,
  concat_ws(',', case when champion is null and {stage_rank_sql('stage')} >= 1 then 'champion' end, case when economic_buyer is null and {stage_rank_sql('stage')} >= 2 then 'economic buyer' end,
    case when paper_process is null and {stage_rank_sql('stage')} >= 3 then 'paper process' end) as close_plan_gaps, trend,
  coalesce(people, 0) as people, coalesce(engaged, 0) as engaged, c.opp_id is not null and not exists (select 1 from o_contacts x where x.opp_id = c.opp_id and x.email = c.attendee) as first_time,
  b.mid as last_meeting_id, b.day::varchar as last_day, b.outcome as last_outcome, b.sentiment as last_sentiment,
  coalesce(we_owe, 0) as we_owe, coalesce(they_owe, 0) as they_owe, coalesce(changes, 0)::bigint as card_changes, coalesce(news, 0) as news, latest_news
from c left join opportunities o on o.opp_id = c.opp_id left join o_trend_label t on t.opp_id = c.opp_id left join b on b.meeting_id = c.meeting_id
left join (select opp_id, count(*) as people, count(*) filter (replied) as engaged from o_contacts group by 1) p on p.opp_id = c.opp_id
left join (select account, count(*) filter (direction = 'ours') as we_owe, count(*) filter (direction = 'theirs') as they_owe from commitments where status = 'Open' and due < date '2001-08-02' group by 1) w on w.account = c.account
left join n on n.account = c.account
left join (select opp_id, sum(n) as changes from o_mentions join (select competitor_id, count(*) as n from competitors join signals using (competitor_id) where tier = 'Primary' and event_date > researched group by 1) using (competitor_id) group by 1) b2 on b2.opp_id = c.opp_id""")
def _(t):
    today = cut_lineage(mt.days_meetings(calendar(t), AS_OF), "todays-meetings")
    of_day = lambda df: df.join(today.select("opp_id").distinct(), "opp_id", "left_semi")
    opps, activity = of_day(t.opportunities), cut_lineage(of_day(t.activity), "todays-activity")
    people = deals.reply_evidence(activity)
    return mt.meeting_prep(
        today, opps, deals.close_plan_gaps(opps, STAGES), engagement.engagement_trend(activity, AS_OF), deals.contacts_of(of_day(t.contact_roles), people), t.meetings, t.signals, t.commitments,
        cp.competitor_mentions(of_day(t.deal_notes), t.competitors), cp.stale_battlecards(t.competitors, t.signals), AS_OF)


@query("meeting_news", """
select related_account as account, event_date::varchar as event_date, signal_id, signal_type from signals where event_date between date '2001-07-03' and date '2001-08-02'
  and related_account in (select account from calendar where day = date '2001-08-02')""")
def _(t):
    return mt.meeting_news(mt.days_meetings(t.calendar, AS_OF), t.signals, AS_OF)


@query("sentiment_trajectory", """
with m as (select x.*, case sentiment when 'Positive' then 3 when 'Neutral' then 2 when 'Mixed' then 1 else 0 end as r from (select *, meeting_id % 20 as grp from meetings) x where sentiment <> 'Unclear'),
w as (select *, lag(sentiment) over q as b1, lag(sentiment, 2) over q as b2, lag(r) over q as r1, lag(r, 2) over q as r2 from m window q as (partition by grp order by day, meeting_id))
select meeting_id, grp as account, sentiment, b1 as before_1, b2 as before_2, sentiment_evidence, coalesce(r < r1 and r1 < r2 and o.stage in ('Validate', 'Proposal', 'Negotiate'), false) as sliding
from w left join latest_open l on w.account = l.open_account left join opportunities o on l.open_opp = o.opp_id""")
def _(t):
    held = meetings_with_deal(t).withColumn("account", F.col("meeting_id") % 20)
    return mt.sentiment_trajectory(held, t.opportunities)
