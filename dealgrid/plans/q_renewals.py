"""Renewal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import fx, renewals
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF

YEAR = ("2001-01-01", "2001-12-31")


def linked(t: Tables):
    return renewals.link_renewal_opp(t.renewals, t.opps_tracked)


def valued(t: Tables):
    closed = F.col("status") != "Active"
    out = fx.fx_convert(t.renewals, t.fx_rates, AS_OF, amount="current_value", closed=closed, close_day="contract_end")
    out = out.withColumnRenamed("converted_amount", "converted_current_value").drop("rate_used", "frozen")
    out = fx.fx_convert(out, t.fx_rates, AS_OF, amount="proposed_value", closed=closed, close_day="contract_end")
    return out.withColumnRenamed("converted_amount", "converted_proposed_value")


@query("renewal_deadlines", """
select renewal_id, (contract_end - lead_days)::varchar as conversation_target_date, (contract_end - notice_days)::varchar as notice_deadline,
  (contract_end - date '2001-08-02')::bigint as days_to_expiry, (contract_end - lead_days - date '2001-08-02')::bigint as days_to_conversation_target from renewals""")
def _(t):
    return renewals.renewal_deadlines(t.renewals, AS_OF).select(
        "renewal_id", "conversation_target_date", "notice_deadline", "days_to_expiry", "days_to_conversation_target")


@query("idle_outcome", "select renewal_id, case when coalesce(auto_renew, false) then 'auto-renews' else 'lapses' end as idle_outcome from renewals")
def _(t):
    return renewals.idle_outcome(t.renewals, False).select("renewal_id", "idle_outcome")


@query("renewal_outcome", """
select renewal_id, coalesce(crm_outcome, case when status = 'Churned' then 'churned' when proposed_value > current_value then 'expanded' when proposed_value < current_value then 'contracted' else 'flat' end) as outcome
from renewals where status <> 'Active'""")
def _(t):
    return renewals.renewal_outcome(t.renewals).select("renewal_id", "outcome")


@query("link_contracts", """
with r as (select * replace (case when champion_still_there then original_opp_id end as original_opp_id, case when champion_still_there then contract_end else contract_end + 1 end as contract_end) from renewals),
w as (select opp_id, account, close_date + 365 as contract_end from opportunities where stage = 'Closed Won' and close_date + 365 > date '2001-08-02')
select w.opp_id, w.account, w.contract_end::varchar as contract_end, case when d.renewal_id is not null then 'deal' when s.m is not null then 'account and end' else 'new' end as basis, coalesce(d.renewal_id, s.m) as renewal_id
from w left join r d on d.original_opp_id = w.opp_id left join (select account, contract_end, min(renewal_id) as m from r group by 1, 2) s on s.account = w.account and s.contract_end = w.contract_end""")
def _(t):
    stayed = F.col("champion_still_there")
    known = t.renewals.withColumns({"original_opp_id": F.when(stayed, F.col("original_opp_id")), "contract_end": F.when(stayed, F.col("contract_end")).otherwise(F.date_add("contract_end", 1))})
    return renewals.link_contracts(t.opportunities, known, AS_OF)


@query("link_renewal_opp", """
select renewal_id, renewal_opp_id, renewal_opp_stage, renewal_opp_created::varchar as renewal_opp_created from o_linked""")
def _(t):
    return linked(t).select("renewal_id", "renewal_opp_id", "renewal_opp_stage", "renewal_opp_created")


@query("uncovered_contracts", "select renewal_id, account, current_value::double as current_value from o_linked where status = 'Active' and renewal_opp_id is null")
def _(t):
    return renewals.uncovered_contracts(linked(t), "at-close", AS_OF).select("renewal_id", "account", "current_value")


@query("propose_renewal_opps", """
select renewal_id, account, owner, current_value::double as amount, currency, (contract_end + 1)::varchar as new_start, contract_end::varchar as close_date, 'renewal' as track, 'Qualify' as stage
from o_linked where status = 'Active' and renewal_opp_id is null and contract_end - date '2001-08-02' <= 180""")
def _(t):
    return renewals.propose_renewal_opps(renewals.uncovered_contracts(linked(t), "window", AS_OF))


@query("first_renewal_touch", """
with a as (select distinct account, day from raw_activity where (kind = 'meeting' or direction = 'outbound') and regexp_matches(lower(subject), 'proposal|checking in'))
select renewal_id, r.account, contract_start::varchar as contract_start, min(a.day)::varchar as first_renewal_touch_date
from renewals r left join a on a.account = r.account and a.day > r.contract_start group by 1, 2, 3""")
def _(t):
    return renewals.first_renewal_touch(t.renewals, t.raw_activity, about="proposal|checking in")


@query("renewal_risk_flags", """
select renewal_id, account, owner, current_value::double as current_value, risk_flags, days_overdue, expansion_signal from o_renewal_flags""")
def _(t):
    return renewals.renewal_risk_flags(t.renewals, linked(t), t.raw_activity, AS_OF)


@query("renewal_ranking", """
with s as (select renewal_id, case when risk_flags like '%conversation-overdue%' or risk_flags like '%no-renewal-opp%' then 'commitment missed' when risk_flags like '%conversation-due-soon%' then 'due soon'
    when risk_flags <> '' then 'at risk' when expansion_signal is not null then 'expansion' else 'covered' end as section, (current_value * n_flags)::decimal(18,2)::double as exposure from o_renewal_flags)
select *, case section when 'commitment missed' then 0 when 'due soon' then 1 when 'at risk' then 2 when 'expansion' then 3 else 4 end::bigint as section_no from s""")
def _(t):
    return renewals.renewal_ranking(renewals.renewal_risk_flags(t.renewals, linked(t), t.raw_activity, AS_OF))


@query("expansion_already_open", """
select renewal_id, account from renewals where account in (select account from opps_tracked where is_open and track = 'new')""")
def _(t):
    return renewals.expansion_already_open(t.renewals, t.opps_tracked)


@query("renewal_coverage", """
with v as (select r.*, l.renewal_opp_id from o_valued r join o_linked l using (renewal_id) where r.contract_end between date '2001-01-01' and date '2001-12-31')
select date_trunc('quarter', contract_end)::date::varchar as quarter, coalesce(sum(cv), 0)::double as due,
  coalesce(sum(case when status = 'Downgraded' then least(pv, cv) else cv end) filter (status in ('Renewed', 'Auto-Renewed', 'Downgraded')), 0)::double as secured,
  coalesce(sum(cv) filter (status = 'Churned'), 0)::double as lost, coalesce(sum(cv) filter (status = 'Active' and not champion_still_there), 0)::double as at_risk,
  coalesce(sum(cv) filter (status = 'Active' and renewal_opp_id is null), 0)::double as no_deal, count(*) filter (cv is null) as unconverted,
  coalesce(sum(case when status = 'Downgraded' then least(pv, cv) else cv end) filter (status in ('Renewed', 'Auto-Renewed', 'Downgraded')), 0)::double / sum(cv)::double as coverage
from v group by 1""")
def _(t):
    return renewals.renewal_coverage(valued(t), linked(t), *YEAR)


@query("renewal_movement", """
select renewal_id, status, cv::double as value, case when status = 'Churned' then 0 else cv::double end
  / (select sum(cv)::double from o_valued where contract_end between date '2001-01-01' and date '2001-12-31') as coverage_change
from o_valued where contract_end between date '2001-01-01' and date '2001-12-31' and status <> 'Active' and renewal_id % 5 = 1""")
def _(t):
    cur = valued(t)
    prior = cur.select("renewal_id", F.when(F.col("renewal_id") % 5 == 1, "Active").otherwise(F.col("status")).alias("status"))
    return renewals.renewal_movement(cur, prior, *YEAR)


@query("policy_lag", "select median((renewal_opp_created - contract_start)::double) as median_lag_days, count(*) as contracts from o_linked where renewal_opp_id is not null")
def _(t):
    return renewals.policy_lag(linked(t))


@query("late_touch_on_churn", """
select count(*) as churned, count(*) filter (first_touch is null) as never_touched, count(*) filter (first_touch > contract_end - lead_days) as touched_late from renewals where status = 'Churned'""")
def _(t):
    return renewals.late_touch_on_churn(t.renewals)


@query("churn_clusters", """
select segment, product, cohort, motion, count(*) as churned, sum(current_value)::double as lost_value from (
  select segment, interest as product, year(contract_start)::varchar as cohort, case when coalesce(auto_renew, false) then 'auto' else 'signed' end as motion, current_value
  from renewals left join accounts using (account) where status = 'Churned')
group by grouping sets ((segment), (product), (cohort), (motion), (segment, product), (segment, cohort), (segment, motion), (product, cohort), (product, motion), (cohort, motion))""")
def _(t):
    return renewals.churn_clusters(t.renewals, t.accounts)


@query("renewal_owner_load", """
select b.owner, contracts, book::double as book, coalesce(events, 0) as events, events is null as no_activity
from (select owner, count(*) as contracts, sum(current_value) as book from renewals where status = 'Active' group by 1) b
left join (select actor as owner, count(*) as events from raw_activity where day >= date '2001-08-02' - 1 group by 1) a on a.owner = b.owner""")
def _(t):
    return renewals.renewal_owner_load(t.renewals, t.raw_activity, AS_OF, days=1)
