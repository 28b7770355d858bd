"""Task, rule, brief, asset and completeness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import engagement, leads, tasks as tk
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF

CAPS = {"click": 5, "view": 10, "purchase": 3, "signup": 20}

SCHEMA = """{"columns": [
  {"name": "opp_id", "type": "integer", "owner": "crm"}, {"name": "stage", "type": "enum", "values": ["Qualify", "Discovery", "Validate", "Closed Won"], "owner": "crm", "verify": "yes"},
  {"name": "amount", "type": "money", "owner": "crm"}, {"name": "created", "type": "date", "owner": "local"}, {"name": "next_step", "type": "integer", "owner": "local"}]}"""

DOC_RULES = {"corporate": "thatin|ononst", "product": "inoran", "templates": "orantion", "messaging": "hehely"}
TAGS = ("tag_source", "tag_lang", "tag_audience")




@query("task_verification", """
with c as (select email, day, case when kind = 'email' and direction = 'outbound' then 'email-sent' when kind = 'meeting' then 'calendar-event' when feed = 'crm' then 'crm-field' end as cls from activity),
j as (select t.task_id, t.verify_by, count(c.day) as events, min(c.day) as first_day from tasks t left join c on c.email = t.verify_target and c.cls = t.verify_by and c.day >= t.raised where t.status = 'Open' group by 1, 2)
select task_id, verify_by, events, case when events = 1 then 'closed' when events > 1 then 'near match' else 'open' end as state, case when events = 1 then first_day::varchar end as evidence_day from j""")
def _(t):
    return tk.task_verification(t.tasks, t.activity)


@query("task_dedup", """
select 'opportunity' as related_type, opp_id as related_id, case when opp_id in (select related_id from tasks where status <> 'Done') then 'bump' else 'add' end as action from opportunities""")
def _(t):
    new = t.opportunities.select(F.lit("opportunity").alias("related_type"), F.col("opp_id").alias("related_id"))
    return tk.task_dedup(new, t.tasks)


@query("task_caps", """
select rule_id, day::varchar as day, record_id, score, rank from (
  select event_type as rule_id, day, activity_id as record_id, value as score, row_number() over (partition by event_type, day order by value desc, activity_id) as rank from raw_activity)
where rank <= case rule_id when 'click' then 5 when 'view' then 10 when 'purchase' then 3 when 'signup' then 20 else rank end""")
def _(t):
    raised = t.raw_activity.select(F.col("event_type").alias("rule_id"), "day", F.col("activity_id").alias("record_id"), F.col("value").alias("score"))
    return tk.task_caps(raised, CAPS)


@query("tasks_due", "select task_id, owner, due::varchar as due, (date '2001-08-02' - due)::bigint as days_late from tasks where status <> 'Done' and due <= date '2001-08-02'")
def _(t):
    return tk.tasks_due(t.tasks, AS_OF)


@query("replies_owed", """
select thread, last_in::varchar as last_in, (date '2001-08-02' - last_in)::bigint as age_days from (select thread, max(day) filter (way = 'in') as last_in, max(day) filter (way = 'out') as last_out from mail group by 1)
where last_in is not null and (last_out is null or last_out < last_in)""")
def _(t):
    return tk.replies_owed(t.mail, AS_OF)


@query("followups_ranked", """
select 'deal' as kind, o.opp_id as record_id, (date '2001-08-02' - next_step_date)::bigint as age_days, amount::double as value from opportunities o join o_trend_label l on o.opp_id = l.opp_id where is_open and next_step_date < date '2001-08-02' and trend = 'Cooling'
union all select 'renewal', renewal_id, date '2001-08-02' - (contract_end - lead_days), current_value::double from renewals where status = 'Active' and first_touch is null and contract_end - lead_days <= date '2001-08-02'
union all select 'lead', lead_id, date '2001-08-02' - coalesce(last_activity, created), null from o_eligible where replied_to_sequence""")
def _(t):
    return tk.followups_ranked(
        t.opportunities, engagement.engagement_trend(t.activity, AS_OF), t.renewals, leads.outreach_eligible(t.leads, AS_OF), AS_OF)


@query("persistent_findings", """
with w as (select *, week - (row_number() over (partition by flag, subject order by week) * 7)::int as island from weekly_flags),
r as (select flag, subject, island, min(week) as since, max(week) as last_week, count(*) as weeks from w group by 1, 2, 3)
select flag, subject, since::varchar as since, weeks from r where last_week = date '2001-07-30' and weeks >= 2""")
def _(t):
    return tk.persistent_findings(t.weekly_flags, "2001-07-30")


def rule_input(t: Tables):
    deals = t.opportunities
    fields = t.spark.createDataFrame([(c,) for c in deals.columns], "field string")
    picklists = deals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("stage", "forecast_label")])).alias("p")).select("p.*").distinct()
    return deals, t.task_rules, tk.rule_faults(t.task_rules, fields, picklists)


RULE_FAULTS = """
lists as (select distinct 'stage' as col, stage as value from opportunities union select distinct 'forecast_label', forecast_label from opportunities),
faults as (
  select rule_id, 'unknown field' as fault, field as detail from task_rules where field not in ('stage', 'next_step_date', 'amount', 'is_open', 'champion', 'owner', 'forecast_label')
  union select rule_id, 'unknown value', field || ' ' || op || ' ' || value from task_rules r where field in (select col from lists) and op in ('=', '<>') and not exists (select 1 from lists l where l.col = r.field and l.value = r.value)
  union select rule_id, 'unknown level', coalesce(level, 'none') from task_rules where level is null or level not in ('manual', 'review', 'auto')
  union select rule_id, 'unknown comparison', coalesce(op, 'none') from task_rules where op is null or op not in ('=', '<>', '<', '<=', '>', '>=', 'is empty', 'is filled')
  union select rule_id, 'no daily cap', rule_id from task_rules where level = 'auto' and daily_cap is null
  union select rule_id, 'cap below one', daily_cap::varchar from task_rules where daily_cap < 1)"""


@query("rule_faults", f"with {RULE_FAULTS} select rule_id, fault, detail from faults")
def _(t):
    return rule_input(t)[2]


@query("rule_engine", """
with hits as (
  select 'late-next-step' as rule_id, opp_id, 'review' as level, amount, null as cap from opportunities where is_open and next_step_date < date '2001-08-02'
  union all select 'big-late-stage', opp_id, 'auto', amount, 20 from opportunities where stage = 'Negotiate' and amount > 200000
  union all select 'no-champion', opp_id, 'manual', amount, 50 from opportunities where is_open and champion is null)
select rule_id, day::varchar as day, record_id, level, score::double as score, rank from (
  select rule_id, opp_id as record_id, level, amount as score, created as day, cap, case when cap is not null then row_number() over (partition by rule_id, created order by amount::double desc, opp_id) end as rank
  from hits join (select opp_id, created from opportunities) using (opp_id)) where cap is null or rank <= cap""")
def _(t):
    deals, rules, faults = rule_input(t)
    return tk.rule_engine(deals, rules, faults, "opp_id", F.col("created"), F.col("amount"))


@query("schema_rules", """
select opp_id, case when stage in ('Qualify', 'Discovery', 'Validate', 'Closed Won') then stage end as stage, amount::double as amount, created::varchar as created, null::bigint as next_step,
  concat_ws(',', case when stage not in ('Qualify', 'Discovery', 'Validate', 'Closed Won') then 'stage' end, case when next_step is not null then 'next_step' end) as faults from opportunities""")
def _(t):
    return tk.schema_rules(t.opportunities, SCHEMA)


@query("asset_lookup", """
with r as (select opp_id as request_id, 'src' || (opp_id % 25) as a, case when opp_id % 4 = 0 then null else case opp_id % 5 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'pt' end end as b, 'aud' || (opp_id % 8) as c
  from opportunities where is_open),
p as (select request_id, asset_id, (a = tag_source)::int + coalesce((b = tag_lang)::int, 0) + (c = tag_audience)::int as overlap from r join content_assets s on (a = tag_source or b = tag_lang or c = tag_audience) where s.status = 'Approved'),
m as (select request_id, max(overlap) as overlap from p group by 1)
select r.request_id, min(asset_id) as asset_id, coalesce(max(m.overlap), 0)::bigint as overlap from r left join m on r.request_id = m.request_id left join p on p.request_id = r.request_id and p.overlap = m.overlap group by 1""")
def _(t):
    oid = F.col("opp_id")
    lang = F.when(oid % 5 == 0, "en").when(oid % 5 == 1, "fr").when(oid % 5 == 2, "de").otherwise("pt")
    asked = t.opportunities.filter("is_open").select(
        oid.alias("request_id"), F.concat(F.lit("src"), oid % 25).alias("tag_source"), F.when(oid % 4 != 0, lang).alias("tag_lang"),
        F.concat(F.lit("aud"), oid % 8).alias("tag_audience"))
    return tk.asset_lookup(asked, t.content_assets, TAGS)


@query("provenance_impact", """
with recursive bad as (select signal_id as asset from signals where confidence = 'Rumour' and relevance = 'High' and signal_type = 'merger'),
links as (select asset_id as child, parent_id as parent from content_assets where parent_id is not null),
reach as (select asset, 0 as depth from bad union select l.child, r.depth + 1 from links l join reach r on l.parent = r.asset)
select asset, min(depth)::bigint as depth from reach group by 1 having min(depth) > 0""")
def _(t):
    bad = t.signals.filter("confidence = 'Rumour' and relevance = 'High' and signal_type = 'merger'").select(F.col("signal_id").alias("id"))
    links = t.content_assets.filter("parent_id is not null").select(F.col("asset_id").alias("child"), F.col("parent_id").alias("parent"))
    return tk.provenance_impact(links, bad)


@query("roster_from_hierarchy", """
with recursive users as (select c_custkey as user_id, case when c_custkey = 0 then null else cast(floor((c_custkey - 1) / 8) as bigint) end as manager, c_acctbal > 0 as active from customer),
r as (select user_id as rep, manager, active, 1 as level from users where manager = 0 union all select u.user_id, u.manager, u.active, r.level + 1 from users u join r on u.manager = r.rep)
select rep, manager, level::bigint as level from r where active""")
def _(t):
    users = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") != 0, F.floor((F.col("c_custkey") - 1) / 8)).alias("manager"), (F.col("c_acctbal") > 0).alias("active"))
    return tk.roster_from_hierarchy(users, 0)


@query("registry_completeness", """
select 'leads' as registry, column_name, rows, filled::double / rows::double as fill_rate from (select count(*) as rows, count(email) as email, count(source) as source, count(last_activity) as last_activity from leads)
unpivot (filled for column_name in (email, source, last_activity))
union all select 'opportunities', column_name, rows, filled::double / rows::double from (select count(*) as rows, count(owner) as owner, count(next_step) as next_step, count(champion) as champion from opportunities)
unpivot (filled for column_name in (owner, next_step, champion))""")
def _(t):
    return tk.registry_completeness({
        "leads": t.leads.select("email", "source", "last_activity"), "opportunities": t.opportunities.select("owner", "next_step", "champion")})


@query("asset_outcomes", "select request_origin, outcome, count(*) as assets from content_assets group by 1, 2")
def _(t):
    return tk.asset_outcomes(t.content_assets)


@query("classify_documents", """
select doc_id, case when regexp_matches(lower(text), 'thatin|ononst') then 'corporate' when regexp_matches(lower(text), 'inoran') then 'product' when regexp_matches(lower(text), 'orantion') then 'templates'
  when regexp_matches(lower(text), 'hehely') then 'messaging' else 'not useful' end as doc_group from documents""")
def _(t):
    return tk.classify_documents(t.documents, DOC_RULES)
