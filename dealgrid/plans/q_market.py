"""Market signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import market
from dealgrid.plans.q_deals import stalled
from dealgrid.plans.q_scalars import distance_sql, norm_host_sql, norm_name_sql
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF

ACCT = "case when account % 17 = 0 then 'Компания ' || (account % 7) when account % 19 = 0 then 'Holdings Inc' else 'Acct ' || account || case when account % 2 = 0 then ' Group' else ' LLC' end end"


def named_accounts(t: Tables, only_domains_of: str = "true"):
    """Accounts under trading names; some have no known website."""
    return t.accounts.select("account", F.expr(ACCT).alias("name"), F.when(F.expr(only_domains_of), F.col("website")).alias("website"))


@query("lens_filter", """
select signal_id, case when bool_or(coalesce(lens, 'deal') in ('deal', 'both')) and bool_or(coalesce(lens, 'deal') in ('content', 'both')) then 'both'
  when bool_or(coalesce(lens, 'deal') in ('deal', 'both')) then 'deal' else 'content' end as lens from o_hits join watchlist using (watch_id) group by 1""")
def _(t):
    return market.lens_split(market.watchlist_sweep(t.signals, t.watchlist), t.watchlist)


@query("watchlist_sweep", "select signal_id, watch_id from o_hits")
def _(t):
    return market.watchlist_sweep(t.signals, t.watchlist)


@query("source_yield", """
select w.watch_id, count(h.signal_id) as signals_found, max(event_date)::varchar as last_found, max(event_date) is null or date '2001-08-02' - max(event_date) > 183 as retire
from watchlist w left join o_hits h on w.watch_id = h.watch_id left join signals s on h.signal_id = s.signal_id group by 1""")
def _(t):
    return market.source_yield(market.watchlist_sweep(t.signals, t.watchlist), t.signals, t.watchlist, AS_OF)


@query("relevance_share", """
select count(*) as signals, count(*) filter (relevance = 'High')::double / count(*) as high_share, count(*) filter (relevance = 'High')::double / count(*) >= 1.0 / 3 as warn from signals""")
def _(t):
    return market.relevance_share(t.signals)


def related_records(t: Tables):
    """Deals, running contracts, customers and leads under the names and domains they are known by."""
    named = named_accounts(t, "segment <> 'BUILDING'").withColumnRenamed("website", "domain")
    won = t.opportunities.filter("stage = 'Closed Won'").select("account")
    of = lambda df, key: df.join(named, "account").select(F.col(key).alias("id"), "name", "domain")
    leads = t.leads.select(F.col("lead_id").alias("id"), F.col("company").alias("name"), F.when(~F.col("bounced"), F.col("email")).alias("domain"))
    return market.record_index(
        of(t.opportunities.filter("is_open"), "opp_id"), of(t.renewals.filter("status = 'Active'"), "renewal_id"),
        named.join(won, "account", "left_semi").select(F.col("account").alias("id"), "name", "domain"), leads)


RELATED = f"""
named as (select account, {ACCT} as name, case when segment <> 'BUILDING' then website end as dom from accounts),
recs as (select 'opportunity' as related_type, 1 as priority, opp_id as id, name, dom from opportunities join named using (account) where is_open
  union all select 'renewal', 2, renewal_id, name, dom from renewals join named using (account) where status = 'Active'
  union all select 'customer', 3, account, name, dom from named where account in (select account from opportunities where stage = 'Closed Won')
  union all select 'lead', 4, lead_id, company, case when not bounced then email end from leads),
idx as (select related_type, priority, id, 'domain ' || {norm_host_sql('dom')} as match_key from recs where {norm_host_sql('dom')} is not null
  union all select related_type, priority, id, 'name ' || {norm_name_sql('name')} from recs where {norm_name_sql('name')} is not null)"""


def near_sql(left: str, right: str) -> str:
    """near(l, r, d, score): names of two sets (column nm) that are alike, with the rarest word of each by how often the right side has it."""
    words = "select nm, unnest(list_distinct(string_split(nm, ' '))) as w from"
    longer = "greatest(length(l.nm), length(r.nm))"
    return f"""
freq as (select w, count(*) as c from ({words} {right}) group by 1),
rare_l as (select nm, arg_min(w, row(coalesce(c, 0), w)) as w from ({words} {left}) left join freq using (w) group by 1),
rare_r as (select nm, arg_min(w, row(c, w)) as w from ({words} {right}) join freq using (w) group by 1),
near as (select l.nm as l, r.nm as r, {distance_sql('l.nm', 'r.nm')} as d, 1::double - {distance_sql('l.nm', 'r.nm')}::double / {longer} as score from rare_l l join rare_r r on l.nm <> r.nm and abs(length(l.nm) - length(r.nm)) <= 10
  where {distance_sql('l.nm', 'r.nm')} = 1 or ((list_contains(string_split(r.nm, ' '), l.w) or list_contains(string_split(l.nm, ' '), r.w)) and {distance_sql('l.nm', 'r.nm')} <= floor({longer} * 0.25)))"""


@query("signal_account_link", f"""
with {RELATED},
fold as (select match_key, related_type, priority, min(id) as id, count(*) as n from idx group by all),
s as (select signal_id, 'domain ' || {norm_host_sql('entity_url')} as dk, {norm_name_sql('entity_name')} as nm from signals),
ln as (select distinct nm from s where nm is not null), rn as (select distinct substr(match_key, 6) as nm from fold where match_key like 'name %'),
{near_sql('ln', 'rn')},
hits as (select signal_id, related_type, priority, match_key, id, n, 1 as k, 0 as d, 1::double as score from s join fold on match_key = dk
  union all select signal_id, related_type, priority, match_key, id, n, 2, 0, 1 from s join fold on match_key = 'name ' || nm
  union all select signal_id, related_type, priority, match_key, id, n, 3, d, score from s join near on nm = l join fold on match_key = 'name ' || r)
select signal_id, related_type, priority::bigint as priority, match_key, id as related_id, n as records, case k when 1 then 'domain' when 2 then 'name' else 'near name, review' end as basis, score
from hits qualify row_number() over (partition by signal_id, related_type order by k, d, match_key) = 1""")
def _(t):
    return market.signal_account_link(t.signals, related_records(t))


@query("signal_link_records", f"with {RELATED} select match_key, related_type, id as related_id from idx")
def _(t):
    return related_records(t)


def _two_sides(t: Tables):
    left = t.leads.select(F.col("lead_id").alias("id"), F.col("company").alias("name"), F.when(~F.col("bounced"), F.col("email")).alias("domain"))
    name = F.concat(F.lit("Acct "), F.col("account"), F.when(F.col("account") % 2 == 0, "x").otherwise(""), F.lit(" Group"))
    right = t.accounts.select(F.col("account").alias("id"), name.alias("name"), F.when(F.col("segment") == "MACHINERY", F.col("website")).alias("domain"))
    return left, right


RIGHT_KEYS = f"""
r as (select account as id, case when segment = 'MACHINERY' then {norm_host_sql('website')} end as d, {norm_name_sql("'Acct ' || account || case when account % 2 = 0 then 'x' else '' end || ' Group'")} as n from accounts),
rk as (select 'domain ' || d as match_key, id from r where d is not null union all select 'name ' || n, id from r where n is not null)"""


@query("resolve_account", f"""
with l as (select lead_id as id, case when email is not null and not bounced then {norm_host_sql('email')} end as d, {norm_name_sql('company')} as n from leads),
{RIGHT_KEYS},
f as (select match_key, min(id) as id, count(*) as c from rk group by 1),
j as (select l.*, fd.id as did, fd.c as dc, fn.id as nid, fn.c as nc from l left join f fd on fd.match_key = 'domain ' || l.d left join f fn on fn.match_key = 'name ' || l.n),
ln as (select n as nm, min(id) as left_id, count(*) as lc from j where did is null and nid is null and n is not null group by 1),
rn as (select distinct substr(match_key, 6) as nm from f where match_key like 'name %'),
{near_sql('ln', 'rn')}
select id as left_id, coalesce(did, nid) as right_id, case when did is not null then 'domain ' || d else 'name ' || n end as match_key, case when did is not null then 'domain' else 'name' end as basis,
  coalesce(dc, nc) as sharing, 0 as distance, 1::double as score from j where did is not null or nid is not null
union all select left_id, f.id, match_key, 'near name, review', lc * f.c, near.d, score from near join ln on ln.nm = l join f on match_key = 'name ' || r""")
def _(t):
    return market.resolve_account(*_two_sides(t))


@query("resolve_account_keys", f"with {RIGHT_KEYS} select match_key, id from rk")
def _(t):
    return market.account_keys(_two_sides(t)[1])


def fit_input(t: Tables):
    deals = t.opportunities.filter("is_open").join(t.deal_pains, "opp_id").join(
        t.accounts.select("account", "segment", F.col("size_band").alias("size"), "interest"), "account").select("opp_id", "amount", *market.FIT_TAGS)
    return t.signals.select("signal_id", *[F.col(f"tag_{c}").alias(c) for c in market.FIT_TAGS]), deals


FIT_DEALS = """
fd as (select opp_id, amount, segment, size_band as size, interest, pain from opportunities join deal_pains using (opp_id) join accounts using (account) where is_open),
masks as (select unnest(range(1, 16)) as m)"""
FIT_CLASS = "concat_ws('|', case when m & 1 > 0 then 'segment=' || {0}segment end, case when m & 2 > 0 then 'size=' || {0}size end, case when m & 4 > 0 then 'interest=' || {0}interest end, case when m & 8 > 0 then 'pain=' || {0}pain end)"
FIT_KNOWN = "(m & 1 = 0 or {0}segment is not null) and (m & 2 = 0 or {0}size is not null) and (m & 4 = 0 or {0}interest is not null) and (m & 8 = 0 or {0}pain is not null)"


@query("signal_fit", f"""
with {FIT_DEALS},
s as (select signal_id, tag_segment as segment, tag_size as size, tag_interest as interest, tag_pain as pain from signals),
combos as (select segment, size, interest, pain, count(*) as n, max(row(amount, opp_id)) as top from fd group by all),
pairs as (select signal_id, s.segment, s.size, s.interest, s.pain, coalesce((c.segment = s.segment)::int, 0) + 2 * coalesce((c.size = s.size)::int, 0) + 4 * coalesce((c.interest = s.interest)::int, 0) + 8 * coalesce((c.pain = s.pain)::int, 0) as common, n, top
  from s join combos c on true),
folded as (select signal_id, segment, size, interest, pain, common, sum(n) as n, max(top) as top from pairs where common > 0 group by all)
select signal_id, {FIT_CLASS.format('')} as fit_class, bit_count(m::int)::bigint as hits, sum(n)::bigint as at_least, coalesce(sum(n) filter (common = m), 0)::bigint as exactly, max(top)[2] as largest_deal
from folded join masks on common & m = m group by signal_id, segment, size, interest, pain, m""")
def _(t):
    return market.signal_fit(*fit_input(t))


@query("signal_fit_deals", f"with {FIT_DEALS} select {FIT_CLASS.format('')} as fit_class, opp_id, amount::double as amount from fd join masks on {FIT_KNOWN.format('')}")
def _(t):
    return market.fit_deals(fit_input(t)[1])


EVENTS = rf"""
k as (select signal_id, event_date, case confidence when 'Confirmed' then 3 when 'Reported' then 2 else 1 end as r, signal_type, coalesce({norm_host_sql('entity_url')}, {norm_name_sql('entity_name')}) as entity,
  list_sort(list_filter(list_distinct(string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+')), lambda w: w <> '')) as ws from signal_reports),
w as (select *, case when len(ws) > 0 then array_to_string(ws, ' ') else 'signal ' || signal_id end as words from k),
said as (select words, min(signal_id) as sid, min(event_date) as day, arg_min(row(entity, signal_type), row(-r, event_date, signal_id)) as about, any_value(ws) as ws from w group by 1),
links as (select a.sid as x, b.sid as y from said a join said b on a.about = b.about and a.sid <> b.sid and abs(a.day - b.day) <= 3
  where len(a.ws) > 0 and len(b.ws) > 0 and a.about[1] is not null and 100 * len(list_intersect(a.ws, b.ws)) >= 70 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
reach as (select sid as node, sid as other from said union select node, y from reach join links on other = x),
named as (select node, min(other) as event_id from reach group by 1),
members as (select signal_id, event_id, event_date, r from w join said using (words) join named on sid = node)"""


@query("dedup_signals", f"""
with recursive {EVENTS}
select event_id, arg_min(signal_id, row(-r, event_date, signal_id)) as signal_id, min(event_date)::varchar as event_date, case max(r) when 3 then 'Confirmed' when 2 then 'Reported' else 'Rumour' end as confidence, count(*) as copies
from members group by 1""")
def _(t):
    return market.dedup_signals(market.event_members(t.signal_reports))


@query("event_members", f"with recursive {EVENTS} select signal_id, event_id from members")
def _(t):
    return market.event_members(t.signal_reports).select("signal_id", "event_id")


@query("signal_effect", """
with n as (select related_account as account, signal_type, count(*) as signals, max(event_date) as latest from signals where related_account is not null group by 1, 2),
d as (select o.opp_id, o.account, case when s.stalled then 'stalled' when o.stage = 'Negotiate' then 'committed' else 'open' end as deal_state from opportunities o join o_stalled s on o.opp_id = s.opp_id where o.is_open)
select opp_id, signal_type, deal_state, case signal_type when 'leadership' then case deal_state when 'stalled' then 'chance' when 'committed' then 'risk' else 'watch' end when 'merger' then 'freeze'
    when 'breach' then case deal_state when 'committed' then 'handle with care' else 'chance' end when 'funding' then case deal_state when 'stalled' then 'chance' else 'support' end
    when 'regulation' then 'deadline' when 'hiring' then case deal_state when 'stalled' then 'chance' else 'support' end else 'watch' end as effect, signals, latest::varchar as latest
from d join n on d.account = n.account""")
def _(t):
    return market.signal_effect(t.signals, t.opportunities, stalled(t))


@query("signals_ranked", """
select signal_id, related_account is not null as linked, case relevance when 'High' then 1 when 'Medium' then 2 else 3 end::bigint as relevance_rank, event_date::varchar as event_date from signals where so_what is not null""")
def _(t):
    return market.signals_ranked(t.signals)


@query("recurring_senders", """
with d as (select sender, day, count(*) as n, count(*) filter (has_unsubscribe) as f, count(*) filter (regexp_matches(lower(subject), 'digest|weekly|daily|newsletter')) as g from mail where way = 'in' group by 1, 2),
p as (select *, (day - lag(day) over (partition by sender order by day))::bigint as gap from d),
s as (select sender, sum(n)::bigint as issues, median(gap::double) as median_gap, count(gap) as k, sum(gap)::double as s, sum(gap * gap)::double as ss, sum(f)::bigint as f, sum(g)::bigint as g from p group by 1),
r as (select *, coalesce(issues >= 5 and k > 0 and sqrt(greatest((ss - s * s / k::double) / k::double, 0)) <= 3, false) as regular from s)
select sender, issues, median_gap, case when median_gap <= 2 then 'daily' when median_gap <= 9 then 'weekly' when median_gap <= 35 then 'monthly' else 'irregular' end as cadence, regular,
  regular and f = issues and g > 0 as is_publication from r""")
def _(t):
    return market.recurring_senders(t.mail)
