"""Partner queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.functions.columns import norm_domain
from dealgrid.operators import partners as pt
from dealgrid.plans.common import converted
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF

MONTHS = """(datediff('month', {d}, date '2001-08-02') - case when day({d}) > 2 then 1 else 0 end)::bigint"""
FINDING = "select submission_id, finding, severity, detail, others from o_findings where finding = '{}'"


def by_domain(df, account: str = "account"):
    return df.withColumn("customer_key", F.concat(F.lit("acct"), F.col(account), F.lit(".example.com")))


def submissions(t: Tables):
    return t.submissions.withColumn("customer_key", norm_domain(F.col("domain")))


def registrations(t: Tables):
    regs = by_domain(t.registrations, "customer")
    return regs.withColumn("reg_id", F.concat_ws("-", "partner_id", "customer", "role"))


def claims(t: Tables):
    return pt.live_claims(registrations(t), AS_OF)


def customers(t: Tables):
    return by_domain(t.opportunities.filter("stage = 'Closed Won'")).select("customer_key")


def findings(t: Tables):
    return pt.conflict_check(submissions(t), registrations(t), t.partners, by_domain(t.opportunities), customers(t), AS_OF)


@query("registration_clock", """
select partner_id, customer, role, expires::varchar as expires, case when expires < date '2001-08-02' then 'lapsed' when expires - date '2001-08-02' <= 14 then 'expiring' else 'live' end as state from o_regs""")
def _(t):
    return pt.registration_clock(registrations(t), AS_OF).select("partner_id", "customer", "role", "expires", "state")


@query("conflict_same_tier", FINDING.format("same tier claimed"))
def _(t):
    return pt.conflict_same_tier(submissions(t), registrations(t), AS_OF)


@query("conflict_role", FINDING.format("role not permitted"))
def _(t):
    return pt.conflict_role(submissions(t), t.partners)


@query("conflict_direct", FINDING.format("direct opportunity"))
def _(t):
    return pt.conflict_direct(submissions(t), by_domain(t.opportunities))


@query("conflict_customer", FINDING.format("existing customer"))
def _(t):
    return pt.conflict_customer(submissions(t), customers(t))


@query("conflict_territory", "select submission_id, finding, severity, detail, null::bigint as others from o_territory")
def _(t):
    return pt.conflict_territory(submissions(t), t.partners)


@query("conflict_teaming", "select submission_id, finding, severity, detail, others from o_findings where finding in ('teaming', 'already holds this tier')")
def _(t):
    return pt.conflict_teaming(submissions(t), registrations(t), AS_OF)


@query("conflict_expired", FINDING.format("expired claim"))
def _(t):
    return pt.conflict_expired(submissions(t), registrations(t), AS_OF)


@query("conflict_check", """
select s.submission_id, case max(case severity when 'BLOCK' then 3 when 'CHECK' then 2 when 'note' then 1 end) when 3 then 'BLOCK' when 2 then 'CHECK' when 1 then 'note' else 'clear' end as verdict,
  count(finding) as findings from o_subs s left join o_findings f on s.submission_id = f.submission_id group by 1""")
def _(t):
    return pt.conflict_verdict(submissions(t), findings(t))


@query("conflict_findings", "select submission_id, finding, severity, detail, others from o_findings")
def _(t):
    return findings(t)


@query("claim_holders", """
select customer_key || '/' || case when expires < date '2001-08-02' then 'lapsed' else role end as holder_class, partner_id,
  case when expires < date '2001-08-02' then 'lapsed' when expires - date '2001-08-02' <= 14 then 'expiring' else 'live' end as state, approved::varchar as approved, expires::varchar as expires from o_regs""")
def _(t):
    return pt.claim_holders(registrations(t), AS_OF)


@query("distributor_consistency", """
with h as (select distinct customer_key, partner_id from o_live where role = 'Distributor')
select submission_id, distributor, case when exists (select 1 from h where h.customer_key = s.customer_key and h.partner_id = s.distributor) then 'holds the tier'
    when not exists (select 1 from h where h.customer_key = s.customer_key) then 'free' else 'held by another' end as distributor_state,
  exists (select 1 from h where h.customer_key = s.customer_key and h.partner_id = s.distributor) or not exists (select 1 from h where h.customer_key = s.customer_key) as consistent
from o_subs s where distributor is not null and role <> 'Distributor'""")
def _(t):
    return pt.distributor_consistency(submissions(t), claims(t))


@query("partner_deals", """
with o as (select *, case when opp_id % 2 = 1 and partner_id is not null then partner_id || '-' || account || '-Reseller' end as deal_registration_id from opportunities)
select 'deal' as kind, partner_id, account, opp_id::varchar as ref, amount::double as amount from o where partner_id is not null
union all select 'registration', partner_id, customer, reg_id, null from o_regs where opportunity_id is null and reg_id not in (select deal_registration_id from o where deal_registration_id is not null)""")
def _(t):
    return pt.partner_deals(deals_with_registration(t), registrations(t))


def deals_with_registration(t: Tables):
    """Some deals name a registration, some of them one that isn't there."""
    reg = F.concat_ws("-", F.col("partner_id"), F.col("account"), F.lit("Reseller"))
    return t.opportunities.withColumn("deal_registration_id", F.when((F.col("opp_id") % 2 == 1) & F.col("partner_id").isNotNull(), reg))


@query("tier_attribution", """
with d as (select opp_id, account, partner_id, created, case when opp_id % 2 = 1 then partner_id || '-' || account || '-Reseller' end as reg from opportunities where partner_id is not null),
c as (select opp_id, role, r.partner_id, 0 as k, approved, expires from d join o_regs r on d.reg = r.reg_id
  union all select opp_id, role, r.partner_id, 1, approved, expires from d join o_regs r on r.opportunity_id = d.opp_id
  union all select opp_id, role, r.partner_id, case when created > expires then 3 else 2 end, approved, expires from d join o_regs r on d.account = r.customer and r.approved <= d.created),
best as (select * from c qualify row_number() over (partition by opp_id, role order by k, case when k = 3 then null else approved end, case when k = 3 then expires end desc, partner_id) = 1)
select opp_id, role as tier, partner_id as credited_partner, case when k < 2 then 'registration' when k = 2 then 'live claim' else 'lapsed claim, note' end as basis from best
union all select opp_id, 'unknown', partner_id, 'deal partner' from d where opp_id not in (select opp_id from best)""")
def _(t):
    return pt.tier_attribution(deals_with_registration(t), registrations(t).withColumn("expires", F.date_add("approved", F.col("protection_days"))))


ROUTES = """
able as (select * from partners where enabled_until >= date '2001-08-02' and (roles_supported is null or roles_supported like '%Reseller%')),
area as (select partner_id, margin_pct, unnest(string_split(countries, ';')) as country, segments_served from able),
spots as (select distinct country::varchar as country, segment from accounts),
served as (select s.country, s.segment, a.partner_id, a.margin_pct from spots s join area a on s.country = a.country and (a.segments_served is null or list_contains(string_split(a.segments_served, ';'), s.segment))),
local as (select *, row_number() over (partition by country, segment order by margin_pct, partner_id) as rank from served),
known as (select customer as account, partner_id, margin_pct, row_number() over (partition by customer order by margin_pct, partner_id) as rank
  from (select distinct customer, partner_id from registrations) r join able using (partner_id)),
d as (select o.opp_id, o.account, o.amount, a.country::varchar as country, a.segment from opportunities o join accounts a on o.account = a.account where is_open and o.partner_id is null)"""


def routes(t: Tables):
    able = pt.able_partners(t.partners, AS_OF)
    return pt.route_areas(t.accounts, able), pt.route_known(t.registrations, able)


@query("route_areas", f"with {ROUTES} select country, segment, rank, partner_id, margin_pct::double as margin_pct from local")
def _(t):
    return routes(t)[0]


@query("route_known", f"with {ROUTES} select account, rank, partner_id, margin_pct::double as margin_pct from known")
def _(t):
    return routes(t)[1]


@query("route_deal", f"""
with {ROUTES},
offers as (select opp_id, amount, partner_id, margin_pct, 0 as k from d join local l on d.country = l.country and d.segment = l.segment
  union all select opp_id, amount, partner_id, margin_pct, 1 from d join known n on n.account = d.account),
e as (select opp_id, partner_id, max(amount) as amount, max(margin_pct) as margin_pct, max(k) as k from offers group by 1, 2),
r as (select *, row_number() over (partition by opp_id order by k desc, margin_pct, partner_id) as rank from e)
select opp_id, rank, partner_id, k = 1 as existing_relation, cast(amount * (1 - margin_pct) as decimal(18,2))::double as net_amount from r""")
def _(t):
    return pt.route_candidates(t.opportunities, t.accounts, *routes(t))


@query("route_choice", f"""
with {ROUTES},
ln as (select country, segment, count(*) as n from local group by 1, 2), kn as (select account, count(*) as n from known group by 1)
select opp_id, d.account, d.country, d.segment, coalesce(kn.n, 0) as known_partners, coalesce(ln.n, 0) as area_partners, coalesce(k.partner_id, l.partner_id) as partner_id, k.partner_id is not null as existing_relation,
  cast(amount * (1 - coalesce(k.margin_pct, l.margin_pct)) as decimal(18,2))::double as net_amount
from d left join ln on d.country = ln.country and d.segment = ln.segment left join kn on d.account = kn.account
left join local l on d.country = l.country and d.segment = l.segment and l.rank = 1 left join known k on d.account = k.account and k.rank = 1""")
def _(t):
    return pt.route_deal(t.opportunities, t.accounts, *routes(t))


@query("route_top", f"""
with {ROUTES},
offers as (select opp_id, amount, partner_id, margin_pct, 0 as k from d join local l on d.country = l.country and d.segment = l.segment
  union all select opp_id, amount, partner_id, margin_pct, 1 from d join known n on n.account = d.account),
e as (select opp_id, partner_id, max(amount) as amount, max(margin_pct) as margin_pct, max(k) as k from offers group by 1, 2),
r as (select *, row_number() over (partition by opp_id order by k desc, margin_pct, partner_id) as rank from e)
select opp_id, rank, partner_id, k = 1 as existing_relation, cast(amount * (1 - margin_pct) as decimal(18,2))::double as net_amount from r where rank <= 3""")
def _(t):
    return pt.route_top(t.opportunities, t.accounts, *routes(t), 3)


@query("partner_performance", f"""
with d as (select partner_id, count(*) as deals, count(*) filter (stage = 'Closed Won') as won, count(*) filter (not is_open) as decided,
  coalesce(sum(converted_amount) filter (stage = 'Closed Won'), 0)::decimal(18,2) as gross, max(created) as last_deal from o_conv where partner_id is not null group by 1)
select p.partner_id, motion, coalesce(deals, 0) as deals, gross::double as gross, (case when motion = 'sell-through' then cast(gross * (1 - margin_pct) as decimal(18,2)) else gross end)::double as net,
  case when decided >= 5 then won::double / decided::double end as win_rate, case when decided < 5 then won || ' of ' || decided end as sample_note, {MONTHS.replace('{d}', 'last_deal')} as months_since_last_deal
from partners p left join d on p.partner_id = d.partner_id""")
def _(t):
    return pt.partner_performance(t.partners, converted(t), AS_OF)


@query("months_since_last_deal", f"""
select partner_id, max(created)::varchar as last_deal, {MONTHS.replace('{d}', 'max(created)')} as months from opportunities where partner_id is not null group by 1""")
def _(t):
    return pt.months_since_last_deal(t.opportunities, AS_OF)


@query("partner_roster_ratio", """
select count(*) as nominal, count(*) filter (n > 0) as active, count(*) filter (n > 1) as repeat from partners p left join (
  select partner_id, count(*) as n from opportunities where partner_id is not null and created >= date '2001-01-01' group by 1) d on p.partner_id = d.partner_id""")
def _(t):
    return pt.partner_roster_ratio(t.partners, t.opportunities, AS_OF)


@query("partner_forecast", """
select coalesce(motion, 'direct') as motion, count(*) as deals, coalesce(sum(converted_amount), 0)::double as gross,
  coalesce(sum(converted_amount), 0)::double * case when motion = 'sell-through' then 0.7::double else 1 end as forecast,
  case when motion = 'sell-with' then count(*) / (select count(*) from opportunities where is_open)::double end as attach_rate
from o_conv o left join partners p on o.partner_id = p.partner_id where is_open group by motion""")
def _(t):
    return pt.partner_forecast(converted(t), t.partners)


@query("single_rep_dependency", "select partner_id, owner, deals from o_lone")
def _(t):
    return pt.single_rep_dependency(t.opportunities)


@query("partner_health", """
select p.partner_id, concat_ws(',', case when last_deal is null or date '2001-08-02' - last_deal > 90 then 'no-deals-90d' end, case when motion = 'sell-through' and enabled_until < date '2001-08-02' then 'enablement-lapsed' end,
  case when agreement_end - date '2001-08-02' between 0 and 90 then 'agreement-expiring' end, case when l.partner_id is not null then 'single-rep-dependency' end,
  case when last_qbr is null or last_qbr < date '2001-02-02' then 'no-qbr' end, case when n_claims > 0 and coalesce(won, 0) = 0 then 'registered-never-closed' end) as health_flags
from partners p left join (select partner_id, max(created) as last_deal, count(*) filter (stage = 'Closed Won') as won from opportunities where partner_id is not null group by 1) d on p.partner_id = d.partner_id
left join (select partner_id, count(*) as n_claims from registrations group by 1) c on p.partner_id = c.partner_id left join o_lone l on p.partner_id = l.partner_id""")
def _(t):
    return pt.partner_health(t.partners, t.opportunities, t.registrations, AS_OF)


@query("partner_coverage_gaps", """
with served as (select unnest(string_split(countries, ';')) as country, segments_served from partners
  where partner_id in (select partner_id from opportunities where stage = 'Closed Won' and partner_id is not null and created >= date '2001-04-20'))
select country::varchar as country, segment, count(*) as open_deals, sum(amount)::double as open_amount from opportunities o join accounts a on o.account = a.account
where is_open and not exists (select 1 from served s where s.country = a.country::varchar and (s.segments_served is null or list_contains(string_split(s.segments_served, ';'), a.segment))) group by 1, 2""")
def _(t):
    return pt.partner_coverage_gaps(t.opportunities, t.accounts, t.partners, since="2001-04-20")
