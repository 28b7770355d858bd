"""Deal risk, history and contact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import deals, forecast
from dealgrid.plans.common import STAGES
from dealgrid.plans.q_forecast import stage_rank_sql
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF
from dealgrid.session import cut_lineage

EVENT_ORDER = "day, line, part_no, supp_no, close_date, amount"


def meetings_with_deal(t: Tables):
    return t.sql("select m.*, l.open_opp as opp_id from meetings m left join latest_open l on m.account = l.open_account")


def steps(t: Tables):
    return deals.history_steps(t.opp_history)


@query("close_date_pushes", "select opp_id, close_date_pushes, previous_close_date::varchar as previous_close_date from o_pushes")
def _(t):
    return deals.close_date_pushes(steps(t))


@query("flag_close_date_pushed", """
select opp_id, close_date_pushes, case when close_date_pushes >= 3 then 're-baseline' when close_date_pushes = 2 then 'pattern' when close_date_pushes = 1 then 'normal' else 'none' end as push_band
from o_pushes""")
def _(t):
    return deals.flag_close_date_pushed(deals.close_date_pushes(steps(t)))


@query("days_in_stage", "select opp_id, stage, days_in_stage from o_in_stage")
def _(t):
    return deals.days_in_stage(steps(t), AS_OF)


@query("stage_medians", "select stage, median_days, deals from o_medians")
def _(t):
    return deals.stage_medians(deals.stage_spans(steps(t)))


@query("flag_stalled", "select opp_id, stage, quiet_days, stalled, late_stage from o_stalled")
def _(t):
    return stalled(t)


def stalled(t: Tables):
    seq = steps(t)
    return deals.flag_stalled(
        t.opportunities, deals.last_activity(t.activity), deals.days_in_stage(seq, AS_OF), deals.stage_medians(deals.stage_spans(seq)), AS_OF)


@query("stage_stall", """
select stage, count(*) as open_deals, count(*) filter (stalled) as stalled_deals, count(*) filter (stalled) / count(*)::double as stalled_share from o_stalled group by 1""")
def _(t):
    return deals.stage_stall(stalled(t))


@query("flag_next_step", "select opp_id, cause from o_step where cause is not null")
def _(t):
    return deals.flag_next_step(t.opportunities, AS_OF)


@query("flag_amount_moved", """
select opp_id, day::varchar as day, stage, amount_before::double as amount_before, amount::double as amount, moved_share from o_moved""")
def _(t):
    return deals.flag_amount_moved(steps(t))


@query("hygiene_flags", """
select opp_id, concat_ws(',', case when is_open and close_date < date '2001-08-02' then 'close-date-passed' end, case when owner is null then 'no-owner' end) as hygiene_flags
from opportunities where (is_open and close_date < date '2001-08-02') or owner is null""")
def _(t):
    return deals.hygiene_flags(t.opportunities, AS_OF)


@query("close_plan_gaps", f"""
select opp_id, stage, concat_ws(',', case when champion is null and {stage_rank_sql('stage')} >= 1 then 'champion' end,
  case when economic_buyer is null and {stage_rank_sql('stage')} >= 2 then 'economic buyer' end, case when paper_process is null and {stage_rank_sql('stage')} >= 3 then 'paper process' end) as close_plan_gaps
from opportunities where is_open""")
def _(t):
    return deals.close_plan_gaps(t.opportunities, STAGES)


@query("reply_evidence", "select opp_id, email, replied, case when replied is null then 'none' else 'logged direction' end as reply_evidence from o_replied")
def _(t):
    return deals.reply_evidence(t.activity)


@query("meeting_evidence", """
with r as (select opp_id, email, case feed when 'crm' then 2 when 'calendar' then 1 end as rung from activity where kind = 'meeting' and opp_id is not null
  union all select open_opp, attendee, 3 from meetings m join latest_open l on m.account = l.open_account)
select opp_id, email, case max(rung) when 3 then 'transcript' when 2 then 'opportunity-linked' when 1 then 'invite-accepted' else 'none' end as meeting_evidence from r group by 1, 2""")
def _(t):
    return deals.meeting_evidence(t.activity, meetings_with_deal(t))


@query("activity_noise_filter", """
select activity_id, day::varchar as day, subject from activity where day >= date '2001-07-20' and not regexp_matches(lower(subject), 'automatic reply|checking in')""")
def _(t):
    out = deals.activity_noise_filter(t.activity, "2001-07-20", ["automatic reply", "checking in"])
    return out.select("activity_id", "day", "subject")


@query("untracked_deals", """
select opp_id, account, stage from opportunities where is_open and opp_id not in (select opp_id from activity where opp_id is not null)""")
def _(t):
    return deals.untracked_deals(t.opportunities, t.activity)


@query("contacts_build", "select opp_id, email, source, replied, reply_evidence from o_contacts")
def _(t):
    return deals.contacts_build(t.contact_roles, t.activity)


@query("contacts_rollup", """
select opp_id, count(*) as contacts_attached, count(*) filter (replied) as contacts_engaged, count(*) filter (replied is null) as undetermined from o_contacts group by 1""")
def _(t):
    return deals.contacts_rollup(deals.contacts_build(t.contact_roles, t.activity))


@query("contacts_fold", """
with h as (select open_opp as opp_id, attendee as email, count(*) as n, max(day) as last_day from meetings m join latest_open l on m.account = l.open_account group by 1, 2)
select coalesce(c.opp_id, h.opp_id) as opp_id, coalesce(c.email, h.email) as email, coalesce(source, 'activity-only') as source, replied, coalesce(n, 0) as meetings_attended,
  last_day::varchar as last_meeting, case when n > 0 then 'transcript' end as meeting_evidence
from o_contacts c full join h on c.opp_id = h.opp_id and c.email = h.email""")
def _(t):
    return deals.contacts_fold(deals.contacts_build(t.contact_roles, t.activity), meetings_with_deal(t))


@query("ghost_roles", "select opp_id from o_ghosts")
def _(t):
    return deals.ghost_roles(ghost_input(t.contact_roles), t.activity)


def ghost_input(roles):
    """Some role holders changed their address."""
    moved = (F.col("opp_id") % 9 == 0) & ~F.col("email").startswith("ghost")
    return roles.withColumn("email", F.when(moved, F.concat(F.lit("moved-"), F.col("email"))).otherwise(F.col("email")))


@query("threading_flags", """
select opp_id, state, flags, people, repliers, outbound, inbound from o_threading""")
def _(t):
    people = cut_lineage(deals.people_fold(t.activity), "people")
    return deals.threading_flags(deals.contacts_of(t.contact_roles, people), people, t.opportunities)


def risks(t: Tables):
    """The history is put in order once, and the activity folded once; both serve several flags."""
    seq = cut_lineage(steps(t), "history-steps")
    people, roles = cut_lineage(deals.people_fold(t.activity), "people"), t.landed("contact_roles")
    facts = deals.history_facts(seq, AS_OF)
    last_days = people.groupBy("opp_id").agg(F.max("last_day").alias("last_day"))
    stalls = deals.flag_stalled(t.opportunities, last_days, facts, deals.stage_medians(deals.stage_spans(seq)), AS_OF)
    return deals.risk_flags(
        t.opportunities, facts, stalls, deals.threading_flags(deals.contacts_of(roles, people), people, t.opportunities), deals.ghost_roles(ghost_input(roles), people), AS_OF)


@query("risk_flags", "select opp_id, stage, risk_flags, severity from o_risks")
def _(t):
    return risks(t)


@query("risk_review", f"""
with mv as (select coalesce(p.opp_id, c.opp_id) as opp_id,
  case when p.opp_id is null then 'new' when c.opp_id is null then 'dropped' when p.is_open and not c.is_open then 'closed'
    when c.close_date > p.close_date then 'slipped' when {stage_rank_sql('c.stage')} > {stage_rank_sql('p.stage')} then 'advanced'
    when {stage_rank_sql('c.stage')} < {stage_rank_sql('p.stage')} then 'moved back' else 'unchanged' end as movement
  from opp_prev p full join opp_cur c on p.opp_id = c.opp_id),
rows_ as (select 1 as section_no, 'moved' as section, opp_id, movement as detail, 0 as severity from mv where movement not in ('unchanged', 'dropped')
  union all select case when risk_flags like 'close-date-fictional%' and risk_flags like '%stalled%' then 3 else 2 end,
    case when risk_flags like 'close-date-fictional%' and risk_flags like '%stalled%' then 'decide' else 'at risk' end, opp_id, risk_flags, severity from o_risks where severity > 0)
select r.* replace (section_no::bigint as section_no, severity::bigint as severity), o.owner from rows_ r join opportunities o using (opp_id)""")
def _(t):
    return deals.risk_review(risks(t), forecast.pipeline_movement(t.opp_prev, t.opp_cur, STAGES), t.opportunities)


@query("won_without_customer", """
select opp_id, account from opportunities where stage = 'Closed Won' and account not in (select account from accounts where segment <> 'BUILDING')""")
def _(t):
    return deals.won_without_customer(t.opportunities, t.accounts.withColumn("account", F.when(F.col("segment") != "BUILDING", F.col("account"))))


@query("loss_clusters", """
select loss_reason, source, segment, count(*) as losses, sum(amount)::double as lost_amount from (
  select loss_reason, coalesce(source::varchar, 'none') as source, segment, amount from opportunities o left join accounts a using (account) where stage = 'Closed Lost')
group by grouping sets ((loss_reason), (source), (segment), (loss_reason, source), (loss_reason, segment), (source, segment))""")
def _(t):
    return deals.loss_clusters(t.opportunities, t.accounts)


@query("evidence_struct", """
select opp_id, string_agg(day::varchar || ':' || kind || ':' || n, ',' order by day, kind, n) as evidence from (
  select opp_id, day, kind, count(*) as n from activity where opp_id is not null and day between date '2001-07-19' and date '2001-08-01' group by 1, 2, 3) group by 1""")
def _(t):
    out = deals.evidence_struct(t.activity, "2001-07-19", "2001-08-01")
    text = F.transform("evidence", lambda e: F.concat_ws(":", e["day"].cast("string"), e["kind"], e["n"].cast("string")))
    return out.select("opp_id", text.alias("evidence"))
