"""Registry views over the given tables, in SQL that Spark and DuckDB both read.

All registries run on one clock: AS_OF is the day after the last order, and event and conversation
dates are moved back by a fixed number of days so that they end on the same day.
"""

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AS_OF = "2001-08-02"
CLOCK_SHIFT = 8217

VIEWS = {
    "opportunities": """
select o_orderkey as opp_id, o_custkey as account,
  case when o_custkey % 97 = 0 then null else o_custkey % 25 end as owner,
  cast(o_totalprice as decimal(18,2)) as amount,
  case o_custkey % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' else 'CHF' end as currency,
  case when o_orderstatus = 'F' and o_orderkey % 3 > 0 then 'Closed Won'
       when o_orderstatus = 'F' then 'Closed Lost'
       when o_orderpriority like '1%' then 'Negotiate' when o_orderpriority like '2%' then 'Proposal'
       when o_orderpriority like '3%' then 'Validate' when o_orderpriority like '4%' then 'Discovery'
       else 'Qualify' end as stage,
  o_orderstatus <> 'F' as is_open,
  case when o_orderstatus = 'F' then 'Closed' when o_orderpriority like '1%' then 'Commit'
       when o_orderpriority like '2%' then 'Best Case' else 'Open Pipeline' end as forecast_label,
  cast(o_orderdate as date) as created, cast(o_orderdate as date) + 90 as close_date,
  case when o_orderkey % 6 = 0 then null else 'step ' || (o_orderkey % 9) end as next_step,
  case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) + cast(o_orderkey % 200 as int) end as next_step_date,
  case when o_orderkey % 5 = 0 then null else 'person ' || (o_orderkey % 40) end as champion,
  case when o_orderkey % 4 = 0 then null else 'buyer ' || (o_orderkey % 30) end as economic_buyer,
  case when o_orderkey % 9 = 0 then null else 'known' end as paper_process,
  case when o_orderkey % 4 = 0 then case when o_custkey % 25 = 3 then 200 + o_custkey % 4 else o_custkey % 110 end end as partner_id,
  case when o_custkey % 12 = 0 then null else o_custkey % 12 end as source,
  o_custkey % 24 as source_detail,
  case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then
    case substring(o_orderpriority, 1, 1) when '1' then 'Price' when '2' then 'Competitor' when '3' then 'Timing'
      when '4' then 'No decision' else 'Fit' end end as loss_reason,
  cast(o_orderdate as date) as last_modified
from {orders}""",
    "accounts": """
select c_custkey as account, c_name as name, 'www.acct' || c_custkey || '.example.com' as website,
  c_mktsegment as segment, c_nationkey as country, 'size' || (c_custkey % 4) as size_band,
  'interest' || (c_custkey % 10) as interest, c_custkey % 13 = 0 as runs_competitor
from {customer}""",
    "opps_tracked": """
select o.*, case when f.first_won < o.created then 'renewal' else 'new' end as track
from opportunities o left join (
  select account as won_account, min(created) as first_won from opportunities
  where stage = 'Closed Won' group by account) f on o.account = f.won_account""",
    "opp_prev": """
select opp_id, account, case when opp_id % 13 = 0 then 3 else owner end as owner,
  cast(case when opp_id % 5 = 0 then amount * 0.9 else amount end as decimal(18,2)) as amount, currency,
  case when opp_id % 7 = 0 then 'Qualify' else stage end as stage,
  case when opp_id % 8 = 0 then close_date - 30 else close_date end as close_date,
  opp_id % 7 = 0 or is_open as is_open
from opportunities where created < date '2001-02-01'""",
    "opp_cur": """
select opp_id, account, owner, amount, currency, stage, close_date, is_open
from opportunities where is_open or close_date >= date '1995-09-01'""",
    "opp_local": """
select opp_id, account, owner,
  cast(case when opp_id % 11 = 0 then amount + 100 else amount end as decimal(18,2)) as amount, currency,
  case when opp_id % 22 = 0 then 'Validate' else stage end as stage, close_date,
  'note ' || opp_id as notes, 'OPP-' || opp_id as local_id
from opp_prev""",
    "opp_loose": """
select case when opp_id % 17 = 0 then null else opp_id end as opp_id, owner, amount, stage, close_date from opp_local
union all select opp_id, owner, cast(amount + 1 as decimal(18,2)) as amount, stage, close_date from opp_local where opp_id % 23 = 0 and opp_id % 17 > 0""",
    "opp_history": """
select l_orderkey as opp_id, cast(l_shipdate as date) as day, cast(l_linenumber as bigint) as line, l_partkey as part_no, l_suppkey as supp_no,
  case l_linenumber when 1 then 'Qualify' when 2 then 'Discovery' when 3 then 'Validate' when 4 then 'Proposal'
    when 5 then 'Negotiate' when 6 then 'Closed Won' else 'Closed Lost' end as stage,
  cast(l_shipdate as date) + cast(l_quantity as int) as close_date,
  cast(l_extendedprice as decimal(18,2)) as amount,
  case l_suppkey % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' else 'CHF' end as currency
from {lineitem}""",
    "fx_rates": """
select currency, cast(rate as decimal(18,8)) as rate, source, cast(effective_from as date) as effective_from from (values
  ('EUR', 1.09890110, 'crm', '1995-01-01'), ('GBP', 1.25000000, 'crm', '1995-01-01'),
  ('EUR', 1.12359551, 'crm', '1998-01-01'), ('GBP', 1.28205128, 'crm', '1998-01-01'),
  ('EUR', 1.07526882, 'crm', '2000-06-01'), ('GBP', 1.21951220, 'crm', '2000-06-01'),
  ('EUR', 1.14285714, 'market', '2000-06-01'), ('GBP', 1.26829268, 'market', '2000-06-01'))
  as r(currency, rate, source, effective_from)""",
    "rate_feed": """
select case o_custkey % 3 when 0 then 'EUR' when 1 then 'GBP' else 'SEK' end as currency,
  case when o_orderkey % 2 = 0 then 'crm' else 'market' end as source,
  cast(o_orderdate as date) as effective_from,
  min(cast(cast(80 + (o_orderkey % 15) as decimal(18,8)) / 100 as decimal(18,8))) as units_per_base
from {orders} group by 1, 2, 3""",
    "goals": """
select owner, track, cast(date_trunc('quarter', close_date) as date) as period_start,
  cast(1000000 + 50000 * coalesce(owner, 0) as decimal(18,2)) as target,
  case when coalesce(owner, 0) % 2 = 0 then 'USD' else 'EUR' end as currency,
  cast(date_trunc('quarter', close_date) as date) + cast(coalesce(owner, 0) % 90 as int) as last_confirmed
from opps_tracked group by 1, 2, 3""",
    "team": "select n_nationkey as rep, n_regionkey as manager from {nation} where n_nationkey <> 24",
    "renewals": """
select opp_id as renewal_id, account, owner, currency, opp_id as original_opp_id,
  close_date as contract_start, close_date + 365 as contract_end, amount as current_value,
  cast(amount * (80 + 10 * (opp_id % 5)) / 100 as decimal(18,2)) as proposed_value, 120 as lead_days,
  case when account % 2 = 0 then null else 60 end as notice_days,
  case when opp_id % 5 = 0 then null else opp_id % 2 = 0 end as auto_renew,
  case when opp_id % 6 = 0 then false else true end as champion_still_there,
  case when opp_id % 11 = 0 then null else date '2001-08-02' - cast(opp_id % 400 as int) end as last_qbr,
  case when opp_id % 3 = 0 then null else close_date + 365 - cast(opp_id % 300 as int) end as first_touch,
  case when opp_id % 13 = 0 then 'expanded' end as crm_outcome,
  case when close_date + 365 >= date '2001-08-02' then 'Active' when opp_id % 4 = 0 then 'Churned'
    when opp_id % 4 = 1 then 'Renewed' when opp_id % 4 = 2 then 'Downgraded' else 'Auto-Renewed' end as status,
  case when opp_id % 19 = 0 then 'asked for more seats' end as expansion_signal
from opportunities where stage = 'Closed Won'""",
    "partners": """
select s_suppkey as partner_id, s_name as name, case when s_suppkey % 2 = 0 then 'sell-through' else 'sell-with' end as motion,
  case s_suppkey % 3 when 0 then 'Distributor; Reseller' when 1 then 'Reseller' end as roles_supported,
  cast(cast(10 + s_suppkey % 21 as decimal(18,2)) / 100 as decimal(5,2)) as margin_pct,
  case when s_suppkey % 7 = 0 then null else cast(s_nationkey as string) || ';' || cast((s_nationkey + 1) % 25 as string) end as countries,
  case when s_suppkey % 5 = 0 then null else 'BUILDING;MACHINERY;FURNITURE' end as segments_served,
  cast(s_suppkey * 3 as string) || ';' || cast(s_suppkey * 5 as string) as excluded_accounts,
  cast(s_suppkey as string) || ';' || cast(s_suppkey + 500 as string) as named_accounts,
  case when s_suppkey % 18 = 0 then cast(s_nationkey as string) || '; ' || cast((s_nationkey + 7) % 25 as string) when s_suppkey % 9 = 0 then cast(s_nationkey as string) end as exclusive_territory,
  date '2001-08-02' + cast(s_suppkey % 200 as int) - 60 as enabled_until,
  date '2001-08-02' + cast(s_suppkey % 300 as int) as agreement_end,
  case when s_suppkey % 8 = 0 then null else date '2001-08-02' - cast(s_suppkey * 7 % 400 as int) end as last_qbr
from {supplier}""",
    "registrations": """
select l.l_suppkey as partner_id, o.o_custkey as customer, case when l.l_linestatus = 'O' then 'Distributor' else 'Reseller' end as role,
  min(cast(l.l_shipdate as date)) as approved,
  max(cast(l.l_shipdate as date)) as last_seen,
  cast(30 + 30 * (l.l_suppkey % 4) as int) as protection_days, min(l.l_orderkey) as first_opp,
  case when l.l_suppkey % 2 = 0 then min(l.l_orderkey) end as opportunity_id
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey group by 1, 2, 3, l.l_suppkey""",
    "submissions": """
select o_orderkey as submission_id, o_custkey % 100 as partner_id, o_custkey as customer,
  case when o_orderkey % 3 = 0 then 'Distributor' else 'Reseller' end as role,
  case when o_custkey % 2 = 0 then 'https://www.acct' else 'acct' end || o_custkey || '.example.com' as domain,
  cast(o_custkey % 25 as string) as country,
  case o_custkey % 4 when 0 then 'BUILDING' when 1 then 'MACHINERY' when 2 then 'AUTOMOBILE' else 'FURNITURE' end as segment,
  case when o_orderkey % 4 = 0 then o_orderkey % 100 end as distributor
from {orders} where o_orderstatus = 'O'""",
    "price_list": """
select p_partkey as sku, p_name as name, cast(p_retailprice as decimal(18,2)) as list_price,
  cast(p_retailprice * 0.75 as decimal(18,2)) as floor_price, cast(0.05 as decimal(5,4)) as max_discount,
  cast(1 + p_partkey % 3 as bigint) as increment, cast(1 + p_partkey % 4 as bigint) as min_qty_sold,
  case when p_partkey % 50 = 0 then 'Deprecated' else 'Active' end as status,
  case when p_partkey % 40 = 1 then date '1999-01-01' else date '2005-01-01' end as expires
from {part}""",
    "price_tiers": """
select p_partkey as sku, cast(t.min_qty as bigint) as min_qty, cast(cast(p_retailprice as decimal(18,2)) * t.keep / 100 as decimal(18,2)) as price
from {part} join (values (1, 100), (10, 95), (25, 88), (40, 80)) as t(min_qty, keep) on true""",
    "quotes": """
select o_orderkey as quote_id, o_orderkey as opp_id, o_custkey as account, cast(o_orderdate as date) as issued,
  cast(o_orderdate as date) + 30 as valid_until,
  case when o_orderstatus = 'F' and o_orderkey % 3 > 0 then 'Accepted' when o_orderstatus = 'F' then 'Rejected' end as outcome,
  case when o_custkey % 4 = 0 and o_orderkey % 5 = 0 then 'EUR' else case o_custkey % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' else 'CHF' end end as currency,
  case when o_orderkey % 6 = 0 then null else cast(o_orderdate as date) + 2 end as sent_date
from {orders}""",
    "quote_lines": """
select l_orderkey as quote_id, cast(l_linenumber as bigint) as line_no, l_partkey as sku, l_suppkey as supp_no, cast(l_quantity as bigint) as qty,
  cast(l_extendedprice as decimal(18,2)) as extended, cast(l_discount as decimal(5,4)) as discount,
  case l_returnflag when 'N' then null when 'A' then 'Volume' else 'Strategic' end as discount_reason
from {lineitem}""",
    "latest_open": """
select account as open_account, max(opp_id) as open_opp from opportunities where is_open group by account""",
    "raw_activity": """
select event_id as activity_id, cast(ts as date) - 8217 as day, cast(ts as timestamp) - interval '8217' day as ts, user_id as account,
  case event_type when 'purchase' then 'meeting' when 'signup' then 'reply' else 'email' end as kind,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as person,
  case when cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 10 = 0 then null
    when event_type = 'view' then 'outbound' when event_type = 'purchase' then 'both' else 'inbound' end as direction,
  case event_type when 'error' then 'Automatic reply: away' when 'view' then 'Checking in' when 'click' then 'Re: proposal'
    when 'signup' then 'Re: your note' else 'Call' end as subject,
  event_type, value,
  case event_id % 3 when 0 then 'mail' when 1 then 'calendar' else 'crm' end as feed,
  event_id % 25 as actor
from {events}""",
    "activity": """
select a.*, l.open_opp as opp_id, 'p' || a.person || '@acct' || a.account || '.example.com' as email
from raw_activity a left join latest_open l on a.account = l.open_account""",
    "contact_roles": """
select opp_id, email, min(person) as person from activity where opp_id is not null and person % 4 = 0 group by 1, 2
union all
select opp_id, 'ghost' || min(person) || '@acct' || min(account) || '.example.com' as email, min(person) as person
from activity where opp_id is not null and opp_id % 3 = 0 group by opp_id""",
    "leads": """
select c.c_custkey as lead_id, c.c_name as name, case when c.c_custkey % 25 = 0 then null when c.c_custkey % 25 = 1 then 'Group, Inc.' else 'Acct ' || (c.c_custkey % 200) || ' Inc.' end as company,
  case when c.c_custkey % 9 = 0 then null else 'lead' || (c.c_custkey % 700) || '@acct' || (c.c_custkey % 200) || '.example.com' end as email,
  cast(c.c_nationkey as bigint) as owner, case when c.c_custkey % 12 = 0 then null else c.c_custkey % 12 end as source,
  c.c_custkey % 24 as source_detail,
  case when c.c_acctbal < 0 then 'Disqualified' when c.c_acctbal < 2500 then 'New' when c.c_acctbal < 5000 then 'Working'
    when c.c_acctbal < 7500 then 'Qualified' else 'Nurture' end as status,
  case when c.c_acctbal < 0 then case when c.c_custkey % 2 = 0 then 'Poor fit' else 'Not interested' end end as dq_reason,
  c.c_custkey % 8 = 0 as marketing_opt_out, c.c_custkey % 16 = 0 as direct_opt_out, c.c_custkey % 21 = 0 as bounced,
  c.c_custkey % 31 = 0 as left_company, c.c_custkey % 6 = 0 as in_sequence,
  case when c.c_custkey % 6 = 0 then date '2001-08-02' + cast(c.c_custkey % 11 as int) - 5 end as sequence_next,
  c.c_custkey % 18 = 0 as replied_to_sequence,
  e.last_day as last_activity, e.last_in as last_inbound,
  date '2001-08-02' - cast(c.c_custkey % 120 as int) as created, c.c_mktsegment as interest
from {customer} c left join (
  select account, max(day) as last_day, max(case when direction = 'inbound' then day end) as last_in
  from raw_activity group by account) e on c.c_custkey = e.account""",
    "campaigns": """
select cast(campaign_id as bigint) as campaign_id, cast(source_value as bigint) as source_value, cast(detail as bigint) as detail, cast(cost as decimal(18,2)) as cost,
  cast(started as date) as started from (values
  (1, 1, null, 5000, '2001-01-15'), (2, 2, null, 10000, '2001-02-01'), (3, 3, 3, 15000, '2001-03-01'), (4, 3, 15, 20000, '2001-03-15'),
  (5, 4, null, 25000, '2000-06-01'), (6, 5, null, 30000, '2000-09-01'), (7, 6, null, 35000, '2001-07-01'), (8, 7, null, 40000, '2001-04-01'),
  (9, 8, null, 45000, '1999-05-01'), (10, 9, null, 50000, '2001-05-01'), (11, 10, null, 55000, '2001-06-01'), (12, 10, null, 60000, '2001-06-15'))
  as c(campaign_id, source_value, detail, cost, started)""",
    "competitors": """
select cast(competitor_id as bigint) as competitor_id, name, aliases, tier, cast(researched as date) as researched from (values
  (1, 'Thatin', 'thatin;that in;thth', 'Primary', '2001-07-10'), (2, 'Ononst', 'ononst;onst;the this', 'Primary', '2001-07-20'),
  (3, 'Inoran', 'inoran', 'Secondary', '2001-07-15'), (4, 'Orantion', 'orantion;orantoin', 'Primary', '2001-08-01'),
  (5, 'Hehely', 'hehely', 'Secondary', '2001-07-05'), (6, 'Thtion Ertion', 'thtion;attion', 'Primary', '2001-07-25'),
  (7, 'Erkeit', 'erkeit;er keit', 'Watch', '2001-06-30'), (8, 'Ouwhea The Of', 'rend and threlyes ofthstthor nd;новый рынок;...', 'Watch', '2001-06-30')) as c(competitor_id, name, aliases, tier, researched)""",
    "deal_notes": "select doc_id as note_id, doc_id * 7 as opp_id, text from {documents}",
    "signals": """
select doc_id as signal_id, date '2001-07-03' + cast(doc_id % 30 as int) as event_date,
  date '2001-07-03' + cast(doc_id % 30 as int) + cast(doc_id % 6 as int) as arrived, source as source_name,
  case doc_id % 4 when 0 then 'Newsletter' when 1 then 'Web' else 'Press' end as source_type,
  case doc_id % 7 when 0 then 'breach' when 1 then 'leadership' when 2 then 'funding' when 3 then 'regulation'
    when 4 then 'merger' when 5 then 'hiring' else 'launch' end as signal_type,
  case doc_id % 4 when 0 then 'High' when 1 then 'Medium' else 'Low' end as relevance,
  case doc_id % 3 when 0 then 'Confirmed' when 1 then 'Reported' else 'Rumour' end as confidence,
  case when doc_id % 9 = 0 then null else 'act on ' || doc_id end as so_what,
  case when doc_id % 5 = 0 then null else doc_id % 150 end as related_account,
  case when doc_id % 6 = 0 then 1 + doc_id % 7 end as competitor_id,
  case doc_id % 5 when 0 then 'No impact' when 1 then 'pricing pressure' when 2 then 'new capability' when 3 then 'weakness exposed' else 'funding' end as impact,
  case when doc_id % 4 = 1 then 'yes' else 'no' end as content_reviewed,
  case when doc_id % 8 = 1 then 'no standing' end as declined_reason,
  'http://www.acct' || (doc_id % 150) || '.example.com/news/' || doc_id as entity_url,
  case when doc_id % 11 = 0 then 'ООО «Компания ' || (doc_id % 7) || '»' when doc_id % 13 = 0 then 'The Group' when doc_id % 17 = 0 then '日本' || (doc_id % 5) when doc_id % 19 = 0 then null
    else 'Acct ' || (doc_id % 150) || case when doc_id % 3 = 0 then ' Corporation' when doc_id % 3 = 1 then ', Inc.' else 's' end end as entity_name,
  case doc_id % 5 when 0 then 'AUTOMOBILE' when 1 then 'BUILDING' when 2 then 'FURNITURE' when 3 then 'MACHINERY' else 'HOUSEHOLD' end as tag_segment,
  'size' || (doc_id % 4) as tag_size, 'interest' || (doc_id % 10) as tag_interest, case when doc_id % 7 > 0 then 'pain' || (doc_id % 12) end as tag_pain,
  case when doc_id % 10 = 3 then text || ' Это новый рынок, Élan vital.' when doc_id % 50 = 7 then '' when doc_id % 50 = 8 then ' ... !' when doc_id % 50 = 9 then null else text end as text
from {documents}""",
    "signal_reports": """
select signal_id, event_date, signal_type, confidence, entity_url, entity_name, text from signals
union all
select signal_id + 10000000 as signal_id, event_date + 1 as event_date, signal_type, 'Reported' as confidence, entity_url, entity_name, text || ' Reported again by another source.' as text
from signals where signal_id % 5 = 2
union all
select signal_id + 20000000 as signal_id, event_date, signal_type, 'Rumour' as confidence, entity_url, entity_name, reverse(text) as text from signals where signal_id % 25 = 3
union all
select signal_id + 30000000 as signal_id, event_date + 20 as event_date, signal_type, 'Rumour' as confidence, entity_url, entity_name, text || ' Once more.' as text from signals where signal_id % 40 = 6""",
    "deal_pains": "select o_orderkey as opp_id, case when o_orderkey % 5 > 0 then 'pain' || (o_custkey % 12) end as pain from {orders}",
    "deal_stack": """
select o_orderkey as opp_id, case o_orderkey % 13 when 0 then 'Thatin; Jira' when 1 then 'ONST;Slack' when 2 then 'Erkeit' when 3 then 'Jira' when 4 then ' er keit ; Hehely ;' end as tech_stack,
  case when o_orderkey % 29 = 0 then 'Lost to Inoran on price' when o_orderkey % 29 = 1 then 'thth, they said' when o_orderkey % 29 = 2 then 'No budget' end as loss_note
from {orders}""",
    "watchlist": """
select cast(watch_id as bigint) as watch_id, kind, term, lens, evidence_ref from (values
  (1, 'Account', 'thatin', 'deal', null), (2, 'Technology', 'ononst', 'content', 'row 4'), (3, 'Regulation', 'orantion', 'both', 'row 7'),
  (4, 'Technology', 'inoran', null, null), (5, 'Newsletter', 'hehely', 'deal', null), (6, 'Person', 'that in', 'deal', null),
  (7, 'Technology', 'zzzqqq', 'content', null), (8, 'Account', 'ouwhea the of', 'both', 'row 8'), (9, 'Technology', 'and threlyes ofthstthor nd', 'deal', null),
  (10, 'Technology', 'rend and threlyes ofthstthor nd', 'deal', null), (11, 'Account', 'новый рынок', 'content', 'row 9'), (12, 'Person', 'élan', null, null)) as w(watch_id, kind, term, lens, evidence_ref)""",
    "content_opps": """
select doc_id as content_id, doc_id as signal_id, date '2001-07-03' + cast(doc_id % 30 as int) as logged,
  case doc_id % 4 when 0 then 'Hours' when 1 then 'Days' when 2 then 'Weeks' else 'Evergreen' end as perishability,
  case doc_id % 5 when 0 then 'New' when 1 then 'Drafting' when 2 then 'In Review' when 3 then 'Approved' else 'Published' end as status,
  case when doc_id % 6 = 0 then null else doc_id % 10 end as standing_ref,
  'topic' || (doc_id % 14) as topic, case when doc_id % 5 = 4 then 1 + doc_id % 15 end as campaign_id
from {documents}""",
    "standing": """
select cast(standing_id as bigint) as standing_id, confirmed from (values (1, true), (2, true), (3, true), (4, true), (5, false), (6, true), (7, true), (8, true))
  as s(standing_id, confirmed)""",
    "exclusions": "select topic from (values ('topic3'), ('topic9')) as e(topic)",
    "turns": """
select conv_id as meeting_id, turn, role, text, date '2001-07-03' + cast(conv_id % 30 as int) as day, conv_id % 150 as account
from {conversations}""",
    "spoken": """
select meeting_id, turn, role, case (meeting_id + turn) % 11 when 0 then 'I will send it by Friday. ' when 1 then 'Good, we''ll look into that. ' when 2 then 'There is no budget this year. ' when 3 then 'Looking forward to it, my VP too. '
    when 4 then 'We are consolidating, and may cancel. ' when 5 then 'Another team needs more seats until next week. ' when 6 then 'Let me send the paper until end of march! ' when 7 then 'He said iwill and nobudget. ' else '' end || text as text, day, account
from turns""",
    "meetings": """
select meeting_id, min(day) as day, min(account) as account, count(*) as n_turns,
  max(case when turn = 0 then text end) as summary, max(case when turn = 1 then text end) as key_quote,
  case meeting_id % 5 when 0 then 'Positive' when 1 then 'Mixed' when 2 then 'Neutral' when 3 then 'Negative' else 'Unclear' end as sentiment,
  case when meeting_id % 4 = 0 then null else 'quoted' end as sentiment_evidence,
  case when meeting_id % 3 = 0 then 'Advanced' else 'Neutral' end as outcome,
  'p' || (meeting_id % 60) || '@acct' || min(account) || '.example.com' as attendee,
  meeting_id % 5 = 0 as about_contract
from turns group by meeting_id""",
    "calendar": """
select meeting_id, date '2001-08-01' + cast(meeting_id % 3 as int) as day, account, attendee,
  case when meeting_id % 7 = 0 then null else meeting_id % 26 end as owner
from meetings""",
    "commitments": """
select meeting_id * 100 + turn as commitment_id, meeting_id, account, case when role = 'assistant' then 'ours' else 'theirs' end as direction,
  text as what, day + 7 as due, case when turn % 2 = 0 then 'Open' else 'Done' end as status, account % 25 as owner
from turns where role <> 'system'""",
    "tasks": """
select opp_id as task_id, 'opportunity' as related_type, opp_id as related_id, owner, created as raised, created + 14 as due,
  case opp_id % 5 when 0 then 'Done' when 1 then 'Awaiting Approval' else 'Open' end as status,
  case opp_id % 3 when 0 then 'email-sent' when 1 then 'calendar-event' else 'crm-field' end as verify_by,
  account as target_account, 'p' || (opp_id % 100) || '@acct' || account || '.example.com' as verify_target
from opportunities where is_open""",
    "task_rules": """
select rule_id, field, op, value, level, cast(daily_cap as int) as daily_cap, active from (values
  ('late-next-step', 'is_open', '=', 'true', 'review', null, true), ('late-next-step', 'next_step_date', '<', '2001-08-02', 'review', null, true),
  ('big-late-stage', 'stage', '=', 'Negotiate', 'auto', 20, true), ('big-late-stage', 'amount', '>', '200000', 'auto', 20, true),
  ('no-champion', 'is_open', '=', 'true', 'manual', 50, true), ('no-champion', 'champion', 'is empty', null, 'manual', 50, true),
  ('old-status', 'stage', '=', 'Prospecting', 'review', null, true), ('loud', 'amount', '>', '5', 'always', null, true),
  ('uncapped', 'amount', '>', '5', 'auto', null, true), ('lost-column', 'mood', '=', 'good', 'review', null, true), ('asleep', 'is_open', '=', 'true', 'review', null, false),
  ('odd', 'amount', 'around', '5', 'review', 0, true)) as r(rule_id, field, op, value, level, daily_cap, active)""",
    "content_assets": """
select doc_id as asset_id, case when doc_id = 0 then null else cast(floor((doc_id - 1) / 4) as bigint) end as parent_id,
  case when doc_id % 10 = 3 then cast(floor(doc_id / 10) as bigint) end as signal_used,
  case doc_id % 3 when 0 then 'Approved' when 1 then 'Draft' else 'Retired' end as status,
  case doc_id % 4 when 0 then 'meeting' when 1 then 'deal' when 2 then 'inbound' else 'campaign' end as request_origin,
  case doc_id % 5 when 0 then 'used-won' when 1 then 'used-lost' when 2 then 'unused' end as outcome,
  source as tag_source, lang as tag_lang, 'aud' || (doc_id % 6) as tag_audience
from {documents}""",
    "snapshots": """
select cadence, taken_at, commit_total, open_count from (
  select 'weekly' as cadence, cast(date_trunc('week', created) as date) as taken_at, sum(amount) as commit_total, count(*) as open_count
  from opportunities group by 2
  union all
  select 'monthly' as cadence, cast(date_trunc('month', created) as date) as taken_at, sum(amount) as commit_total, count(*) as open_count
  from opportunities group by 2) s""",
    "weekly_flags": """
select kind as flag, account as subject, cast(date_trunc('week', day) as date) as week
from raw_activity group by 1, 2, 3""",
    "change_log": """
select o_orderkey as entry_id, case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end as version,
  case when o_orderkey % 5 = 0 then '  ' else 'changed ' || o_orderpriority end as body
from {orders}""",
    "drift_log": """
select l_orderkey as record_id, case l_linenumber % 4 when 0 then 'owner' when 1 then 'amount' when 2 then 'stage' else 'close_date' end as field,
  cast(l_shipdate as date) as day, l_returnflag as from_value, l_linestatus as to_value,
  case when l_returnflag = 'R' then 'AHEAD' when l_returnflag = 'A' then 'DRIFT' else 'CONFLICT' end as drift_class
from {lineitem}""",
    "mail": """
select activity_id as mail_id, 'news' || account || '@sender' || (account % 40) || '.example.com' as sender, account, day,
  cast(account as string) || '-' || cast(person as string) as thread,
  case when event_type = 'view' then 'out' else 'in' end as way,
  case when account % 3 = 0 then 'Weekly digest' else 'Re: plan' end as subject, account % 3 = 0 as has_unsubscribe
from raw_activity where event_type <> 'purchase'""",
    "schema_local": """
select p_brand as registry, p_partkey as column_no, case when p_size > 8 then 'col_' else 'own_' end || p_partkey as column_name,
  case p_partkey % 3 when 0 then 'enum' when 1 then 'string' else 'date' end as column_type,
  case when p_partkey % 3 = 0 then 'a;b;' || p_type end as enum_values,
  case p_partkey % 4 when 0 then 'crm' when 1 then 'local' when 2 then 'derived' end as owner,
  case when p_partkey % 5 = 0 then 'yes' end as verify
from {part}""",
    "schema_new": """
select p_brand as registry, p_partkey as column_no, case when p_size < 42 then 'col_' else 'new_' end || p_partkey as column_name,
  case p_partkey % 6 when 0 then 'enum' when 3 then 'enum' when 1 then 'date' else 'string' end as column_type,
  case when p_partkey % 3 = 0 then 'a;b;c' end as enum_values,
  case when p_partkey % 7 = 0 then null else 'crm' end as owner, 'no' as verify, p_partkey % 10 = 1 as owner_corrected, p_partkey % 15 = 5 as verify_corrected
from {part}""",
    "settings_local": "select p_brand as registry, case p_size % 8 when 0 then 'archive' when 1 then 'path' when 2 then 'id_prefix' when 3 then 'id_width' when 4 then 'note' when 5 then 'version' when 6 then 'retention' else 'label' end as setting, min(p_type) as value from {part} where p_size % 5 <> 0 group by 1, 2",
    "settings_new": "select p_brand as registry, case p_size % 8 when 0 then 'archive' when 1 then 'path' when 2 then 'id_prefix' when 3 then 'id_width' when 4 then 'note' when 5 then 'version' when 6 then 'retention' else 'label' end as setting, min(case when p_size % 3 = 0 then p_type else 'shipped' end) as value from {part} where p_size % 8 <> 4 and p_size % 7 <> 0 group by 1, 2",
    "manifest_new": "select doc_id as obj, source as section, sha2(text, 256) as hash from {documents} where source <> 'src5'",
    "manifest_cur": """
select doc_id as obj, sha2(case when doc_id % 5 = 0 then text || '!' when doc_id % 7 = 0 then text || '?' else text end, 256) as hash
from {documents} where source <> 'src7'""",
    "manifest_base": """
select doc_id as obj, sha2(case when doc_id % 3 = 0 then text || '!' else text end, 256) as hash
from {documents} where source <> 'src11'""",
    "manifest_disk": """
select doc_id as obj, sha2(case when doc_id % 5 = 0 then text || '!' else text || '?' end, 256) as hash
from {documents} where lang <> 'en'""",
}
