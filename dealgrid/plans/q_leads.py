"""Lead queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import leads
from dealgrid.plans.q_scalars import norm_name_sql
from dealgrid.plans.registry import query
from dealgrid.plans.views import AS_OF

PERSON = "lower(name) || '|' || " + norm_name_sql("company")


@query("contactable_gate", """
select lead_id, not (direct_opt_out or bounced or left_company) as contactable,
  concat_ws(',', case when marketing_opt_out then 'marketing_opt_out' end, case when direct_opt_out then 'direct_opt_out' end, case when bounced then 'bounced' end, case when left_company then 'left_company' end) as contact_restrictions,
  concat_ws(',', case when marketing_opt_out then 'marketing' end, case when direct_opt_out then 'direct' end, case when bounced then 'email' end, case when left_company then 'all' end) as closed_channels,
  case when bounced then 'find a new address' when left_company then 'find the successor' end as next_action
from leads""")
def _(t):
    return leads.contactable_gate(t.leads).select("lead_id", "contactable", "contact_restrictions", "closed_channels", "next_action")


@query("sequence_gate", """
select lead_id, coalesce(in_sequence and sequence_next > date '2001-08-02', false) and not replied_to_sequence as suppressed, replied_to_sequence as replied_first from leads""")
def _(t):
    return leads.sequence_gate(t.leads, AS_OF).select("lead_id", "suppressed", "replied_first")


@query("outreach_eligible", "select lead_id from o_eligible")
def _(t):
    return leads.outreach_eligible(t.leads, AS_OF).select("lead_id")


@query("lead_triage", """
with r as (select *, case when replied_to_sequence then 1 when source in (1, 2, 3) and date '2001-08-02' - last_inbound <= 7 then 2
    when status = 'Working' and date '2001-08-02' - last_activity between 5 and 21 and not in_sequence then 3
    when status = 'New' and last_activity is null and date '2001-08-02' - created >= 2 then 4 else 5 end as tier,
  date '2001-08-02' - coalesce(last_activity, created) as wait_days from o_eligible)
select tier::bigint as tier, lead_id, reason, leads::bigint as leads from (
  select tier, lead_id, name || ' - ' || case tier when 1 then 'answered the sequence' when 2 then 'recent inbound' when 3 then 'going cold' else 'never touched' end || ' ' || wait_days || ' days' as reason, 1 as leads
  from r where tier < 5 order by tier, wait_days desc, lead_id limit 10)
union all select 5, null, 'everything else', count(*) from r where tier = 5""")
def _(t):
    return leads.lead_triage(t.leads, AS_OF, [1, 2, 3])


MATCHED = f"""
l as (select lead_id, case when lead_id % 4 = 0 then 'L' || lead_id end as crm_id, lower(email) as mail, {PERSON} as person from leads),
i as (select lead_id + 5 as incoming_id, case when lead_id % 8 = 0 then 'L' || lead_id end as crm_id,
  lower(case when lead_id % 3 = 0 then null when lead_id % 7 = 0 then 'new' || email else email end) as mail, {PERSON.replace("(name)", "(case when lead_id % 11 = 0 then null else name end)")} as person from leads),
a as (select crm_id, min(lead_id) as m, count(*) as n from l where crm_id is not null group by 1),
b as (select mail, min(lead_id) as m, count(*) as n from l where mail is not null group by 1), c as (select person, min(lead_id) as m, count(*) as n from l where person is not null group by 1),
matched as (select incoming_id, case when a.m is not null then 'id' when b.m is not null then 'email' when c.m is not null then 'name and company' else 'none' end as match_tier,
  coalesce(a.m, b.m, c.m) as candidate_id, case when a.m is not null then a.n when b.m is not null then b.n when c.m is not null then c.n else 0 end as candidates,
  case when a.m is not null then i.crm_id when b.m is not null then i.mail when c.m is not null then i.person end as match_key
from i left join a on i.crm_id = a.crm_id left join b on i.mail = b.mail left join c on i.person = c.person)"""


def lead_sides(t):
    lid = F.col("lead_id")
    known = t.leads.select("lead_id", F.when(lid % 4 == 0, F.concat(F.lit("L"), lid)).alias("crm_id"), "email", "name", "company")
    incoming = t.leads.select(
        (lid + 5).alias("incoming_id"), F.when(lid % 8 == 0, F.concat(F.lit("L"), lid)).alias("crm_id"),
        F.when(lid % 3 == 0, None).when(lid % 7 == 0, F.concat(F.lit("new"), "email")).otherwise(F.col("email")).alias("email"),
        F.when(lid % 11 == 0, None).otherwise(F.col("name")).alias("name"), "company",
    )
    return incoming, known


@query("match_leads", f"with {MATCHED} select * from matched")
def _(t):
    return leads.match_leads(*lead_sides(t))


@query("match_candidates", f"""with {MATCHED},
k as (select 'id' as match_tier, crm_id as match_key, lead_id from l union all select 'email', mail, lead_id from l union all select 'name and company', person, lead_id from l)
select * from k where match_key is not null and (match_tier, match_key) in (select match_tier, match_key from matched where match_key is not null)""")
def _(t):
    incoming, known = lead_sides(t)
    return leads.match_candidates(leads.match_leads(incoming, known), known)


@query("duplicate_leads", f"""
with k as (select lower(email) as k, lead_id, 'email' as tier from leads where email is not null
  union all select {PERSON.replace("(name)", "('Person ' || (lead_id % 300))")}, lead_id, 'name and company' from leads where {norm_name_sql("company")} is not null)
select first_id, lead_id as other_id, tier from (select *, min(lead_id) over (partition by tier, k) as first_id from k) where lead_id > first_id""")
def _(t):
    return leads.duplicate_leads(t.leads.withColumn("name", F.concat(F.lit("Person "), F.col("lead_id") % 300)))


@query("convert_leads", """
select lead_id + 900000 as opp_id, company, source, source_detail, interest as product_interest, name as champion, owner, lead_id as from_lead from leads where status = 'Qualified'""")
def _(t):
    deals, _ = leads.convert_leads(t.leads, 900000)
    return deals


@query("lead_shape", """
select count(*) as leads, count(*) filter (not (direct_opt_out or bounced or left_company)) as contactable, count(*) filter (in_sequence) as in_sequence,
  count(*) filter (email is null) as no_email, count(*) filter (last_activity is null or date '2001-08-02' - last_activity >= 30) as untouched from leads""")
def _(t):
    return leads.lead_shape(t.leads, AS_OF)


@query("disqualification_runs", """
select source, count(*) filter (dq_reason = 'Poor fit') as poor_fit, count(*) filter (dq_reason = 'Not interested') as not_interested from leads where dq_reason is not null group by 1""")
def _(t):
    return leads.disqualification_runs(t.leads)


@query("rep_unworked", """
select owner, count(*) filter (status = 'New' and last_activity is null) as unworked_new, count(*) filter (replied_to_sequence) as unanswered_replies from leads group by 1""")
def _(t):
    return leads.rep_unworked(t.leads)


@query("lead_flow_trend", """
select date_trunc('week', created)::date::varchar as week, source, count(*) as leads, count(*) filter (not (direct_opt_out or bounced or left_company)) / count(*)::double as contactable_share
from leads group by 1, 2""")
def _(t):
    return leads.lead_flow_trend(t.leads)


@query("unsourced_leads", """
select count(*) filter (source is null) as unsourced, count(*) as leads, count(*) filter (source is null) / count(*)::double as share from leads""")
def _(t):
    return leads.unsourced_leads(t.leads)


@query("picklist_check", """
select opp_id, concat_ws(',', case when stage not in ('Qualify', 'Discovery', 'Validate', 'Proposal', 'Closed Won') then 'stage' end,
  case when loss_reason not in ('Price', 'Timing') then 'loss_reason' end) as unknown_values from opportunities""")
def _(t):
    lists = {"stage": ["Qualify", "Discovery", "Validate", "Proposal", "Closed Won"], "loss_reason": ["Price", "Timing"]}
    return leads.picklist_check(t.opportunities, lists).select("opp_id", "unknown_values")


@query("required_guard", """
select signal_id as record_id, 'signal' as kind, concat_ws(',', case when so_what is null then 'no so-what' end, case when source_name is null then 'no source' end) as reasons from signals where so_what is null
union all select meeting_id, 'meeting', 'sentiment without evidence' from meetings where sentiment not in ('Neutral', 'Unclear') and sentiment_evidence is null
union all select content_id, 'content', 'approved without standing' from content_opps where status = 'Approved' and standing_ref is null
union all select quote_id * 100 + line_no, 'quote line', 'discount without reason' from quote_lines where discount > 0 and discount_reason is null""")
def _(t):
    rules = [
        ("signal", t.signals, F.col("signal_id"), {"no so-what": F.col("so_what").isNotNull(), "no source": F.col("source_name").isNotNull()}),
        ("meeting", t.meetings, F.col("meeting_id"),
         {"sentiment without evidence": F.col("sentiment").isin("Neutral", "Unclear") | F.col("sentiment_evidence").isNotNull()}),
        ("content", t.content_opps, F.col("content_id"),
         {"approved without standing": (F.col("status") != "Approved") | F.col("standing_ref").isNotNull()}),
        ("quote line", t.quote_lines, F.col("quote_id") * 100 + F.col("line_no"),
         {"discount without reason": (F.col("discount") == 0) | F.col("discount_reason").isNotNull()}),
    ]
    out = None
    for kind, df, key, rule in rules:
        _, bad = leads.required_guard(df, rule)
        part = bad.select(key.alias("record_id"), F.lit(kind).alias("kind"), "reasons")
        out = part if out is None else out.unionByName(part)
    return out


@query("apply_field_map", "select o_orderkey as opp_id, o_custkey as account, o_orderpriority as priority from orders")
def _(t):
    return leads.apply_field_map(t.orders, {"o_orderkey": "opp_id", "o_custkey": "account", "o_orderpriority": "priority"})


@query("scope_filter", """
select opp_id, owner, 'team' as scope from opportunities where owner in (select rep from team)
union all select opp_id, owner, 'individual' from opportunities where owner = 7 or source = 7""")
def _(t):
    team = leads.scope_filter(t.opportunities, "team", roster=t.team).select("opp_id", "owner", F.lit("team").alias("scope"))
    mine = leads.scope_filter(t.opportunities, "individual", owner=7, second="source")
    return team.unionByName(mine.select("opp_id", "owner", F.lit("individual").alias("scope")))


@query("default_filter", "select lead_id, name, status from leads where status <> 'Qualified'")
def _(t):
    return leads.default_filter(t.leads.select("lead_id", "name", "status", "source"), "status <> 'Qualified'", ["source"])


@query("plan_extract", "select opp_id as id, stage, amount::double as value from opportunities where owner = 7 and stage <> 'Closed Lost'")
def _(t):
    return leads.plan_extract(t.opportunities, {"opp_id": "id", "stage": "stage", "amount": "value"}, "individual", "stage <> 'Closed Lost'", owner=7)
