"""Campaign and content queries."""

from __future__ import annotations

from dealgrid.operators import demand
from dealgrid.plans.common import converted
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF


def funnel(t: Tables):
    return demand.campaign_funnel(t.campaigns, t.leads, converted(t))


@query("campaign_attribution", """
select 'lead' as kind, lead_id as record_id, group_id, 'recorded source' as model from leads join o_groups g on source = source_value and (g.detail is null or g.detail = source_detail)
union all select 'deal', opp_id, group_id, 'recorded source' from opportunities join o_groups g on source = source_value and (g.detail is null or g.detail = source_detail)""")
def _(t):
    return demand.campaign_attribution(t.campaigns, t.leads, t.opportunities)


@query("campaign_funnel", """
select group_id, campaigns, started::varchar as started, cost::double as cost, split_note, leads, leads_contactable, leads_worked, opportunities, still_open, won, pipeline::double as pipeline,
  cost::double / nullif(leads, 0) as cost_per_lead, cost::double / nullif(opportunities, 0) as cost_per_opp, pipeline::double / cost::double as pipeline_roi,
  case when leads >= 5 then opportunities::double / leads end as opp_rate, case when leads < 5 then opportunities || ' of ' || leads end as sample_note from o_funnel""")
def _(t):
    return funnel(t)


@query("campaign_maturity", """
select group_id, (date '2001-08-02' - started)::bigint as age_days, (opportunities - still_open)::double / nullif(opportunities, 0) as resolved_share,
  case when opportunities = 0 then 'No pipeline' when (opportunities - still_open)::double / opportunities >= 0.3 * 2 and date '2001-08-02' - started >= 120 then 'Mature' else 'Too early' end as maturity,
  case when (opportunities - still_open)::double / nullif(opportunities, 0) >= 0.6 and date '2001-08-02' - started >= 120 and opportunities - still_open >= 5 then won::double / (opportunities - still_open) end as win_rate
from o_funnel""")
def _(t):
    return demand.campaign_maturity(funnel(t), 120, AS_OF)


@query("campaign_diagnosis", """
select group_id, leads_worked::double / nullif(leads, 0) as worked_share, leads_contactable::double / nullif(leads, 0) as contactable_share,
  case when leads < 5 then 'too few leads' when leads_worked::double / leads < 0.5 then 'follow-up' when leads_contactable::double / leads < 0.6 then 'targeting' when opportunities = 0 then 'channel' else 'working' end as diagnosis
from o_funnel""")
def _(t):
    return demand.campaign_diagnosis(funnel(t))


@query("attribution_overlap", """
with c as (select opp_id, count(*) as n, max(converted_amount) as amt from o_conv o join campaigns c on o.source = c.source_value group by 1)
select sum(n)::bigint as credits, count(*) as deals, coalesce(sum(amt * n), 0)::decimal(18,2)::double as credited, coalesce(sum(amt), 0)::decimal(18,2)::double as actual,
  (coalesce(sum(amt * n), 0) - coalesce(sum(amt), 0))::decimal(18,2)::double as over from c""")
def _(t):
    from pyspark.sql import functions as F

    opps = converted(t)
    credits = opps.join(t.campaigns, F.col("source") == F.col("source_value")).select(
        F.lit("deal").alias("kind"), F.col("opp_id").alias("record_id"), F.col("campaign_id").alias("group_id"))
    return demand.attribution_overlap(credits, opps)


@query("rep_followup_quality", """
select group_id, owner, count(*) as leads, count(*) filter (status = 'Qualified') as qualified, case when count(*) >= 5 then count(*) filter (status = 'Qualified')::double / count(*) end as rate
from leads join o_groups g on source = source_value and (g.detail is null or g.detail = source_detail) group by 1, 2""")
def _(t):
    return demand.rep_followup_quality(t.leads, t.campaigns)


@query("first_last_touch", """
select opp_id, 'first' as model, event_type as source, day::varchar as day from (select *, row_number() over (partition by opp_id order by day, activity_id) as rn from activity where opp_id is not null) where rn = 1
union all select opp_id, 'last', event_type, day::varchar from (select *, row_number() over (partition by opp_id order by day desc, activity_id desc) as rn from activity where opp_id is not null) where rn = 1""")
def _(t):
    return demand.first_last_touch(t.activity, "first").unionByName(demand.first_last_touch(t.activity, "last"))


@query("perishability_expiry", """
select content_id, case when status in ('New', 'Drafting', 'In Review') and date '2001-08-02' > logged + case perishability when 'Hours' then 1 when 'Days' then 7 when 'Weeks' then 28 end then 'Expired' else status end as status,
  (logged + case perishability when 'Hours' then 1 when 'Days' then 7 when 'Weeks' then 28 end)::varchar as expires from content_opps""")
def _(t):
    return demand.perishability_expiry(t.content_opps, AS_OF).select("content_id", "status", "expires")


@query("standing_gate", """
select content_id, topic, standing_ref, case when topic in (select topic from exclusions) then 'excluded topic' when standing_ref is null then 'no standing'
  when standing_ref in (select standing_id from standing where confirmed) then 'pass' else 'unconfirmed standing' end as verdict from content_opps""")
def _(t):
    return demand.standing_gate(t.content_opps, t.standing, t.exclusions)


@query("campaign_content_link", """
select content_id, c.campaign_id, source_value, source_value is not null as measured from content_opps c left join campaigns m on c.campaign_id = m.campaign_id where status = 'Published'""")
def _(t):
    return demand.campaign_content_link(t.content_opps, t.campaigns)


@query("drafts_in_review", """
select kind, count(*) as drafts, max(date '2001-08-02' - since)::bigint as oldest_days from (
  select 'content' as kind, logged as since from content_opps where status in ('Drafting', 'In Review') union all select 'task', raised from tasks where status = 'Awaiting Approval')
where date '2001-08-02' - since >= 7 group by 1""")
def _(t):
    return demand.drafts_in_review(t.content_opps, t.tasks, AS_OF)
