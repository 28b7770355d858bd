"""Views that only the SQL twins use: another way to the numbers the operators compute."""

ORACLE_VIEWS = {
    "o_spans": """
select currency, rate, effective_from, lead(effective_from) over (partition by currency order by effective_from) as until
from fx_rates where source = 'crm'""",
    "o_conv": """
select o.*, case when o.currency = 'USD' then cast(1 as decimal(18,8)) else r.rate end as rate_used,
  cast(round(o.amount * case when o.currency = 'USD' then cast(1 as decimal(18,8)) else r.rate end, 2) as decimal(18,2)) as converted_amount,
  case forecast_label when 'Best Case' then 'BestCase' when 'Open Pipeline' then 'Pipeline' else forecast_label end as forecast_category
from (select *, case when not is_open then least(close_date, date '2001-08-02') else date '2001-08-02' end as rate_day from opps_tracked) o
left join o_spans r on o.currency = r.currency and o.rate_day >= r.effective_from and (r.until is null or o.rate_day < r.until)""",
    "o_goals": """
select g.*, cast(round(g.target * case when g.currency = 'USD' then cast(1 as decimal(18,8)) else r.rate end, 2) as decimal(18,2)) as converted_target
from goals g left join o_spans r on g.currency = r.currency and date '2001-08-02' >= r.effective_from and r.until is null""",
    "o_trend": """
select opp_id, coalesce(sum(pts) filter (day >= date '2001-08-02' - 14), 0)::bigint as score,
  coalesce(sum(pts) filter (day < date '2001-08-02' - 14), 0)::bigint as prior_score,
  count(*) filter (day >= date '2001-08-02' - 14 and cls in ('inbound', 'meeting')) as answered, count(cls) as known
from o_classed where day < date '2001-08-02' and day >= date '2001-08-02' - 28 group by 1""",
    "o_classed": """
select *, case cls when 'meeting' then 5 when 'inbound' then 3 when 'outbound' then 1 when 'machine' then 0 end as pts from (
  select *, case when kind = 'meeting' then 'meeting' when subject like 'Automatic reply%' then 'machine' else direction end as cls
  from activity where opp_id is not null)""",
    "o_trend_label": """
select opp_id, score, prior_score, case when known = 0 then 'Undetermined'
  when answered > 0 and score >= prior_score * 1.25 then 'Heating' when score <= prior_score * 0.75 or answered = 0 then 'Cooling'
  else 'Steady' end as trend from o_trend""",
    "o_hist": """
select *, lag(close_date) over w as prev_close, lag(stage) over w as prev_stage, lag(amount) over w as prev_amount,
  lead(day) over w as next_day, lead(stage) over w as next_stage, row_number() over w as rn
from opp_history window w as (partition by opp_id order by day, line, part_no, supp_no, close_date, amount)""",
    "o_pushes": """
select opp_id, count(*) filter (close_date > prev_close) as close_date_pushes, max_by(prev_close, rn) filter (close_date <> prev_close) as previous_close_date
from o_hist group by 1""",
    "o_in_stage": """
select opp_id, max_by(stage, rn) as stage, (date '2001-08-02' - max(day) filter (prev_stage is null or stage <> prev_stage))::bigint as days_in_stage
from o_hist group by 1""",
    "o_medians": """
select stage, median((next_day - day)::double) as median_days, count(*) as deals from o_hist where next_day is not null and stage <> next_stage group by 1""",
    "o_stalled": """
select opp_id, stage, quiet_days, coalesce(quiet_days >= 14, false) or coalesce(days_in_stage > median_days * 1.5, false) as stalled,
  (coalesce(quiet_days >= 14, false) or coalesce(days_in_stage > median_days * 1.5, false)) and stage in ('Proposal', 'Negotiate') as late_stage
from (select o.opp_id, o.stage, (date '2001-08-02' - a.last_day)::bigint as quiet_days, i.days_in_stage, m.median_days
  from opportunities o left join (select opp_id, max(day) as last_day from activity where opp_id is not null group by 1) a on o.opp_id = a.opp_id
  left join o_in_stage i on o.opp_id = i.opp_id left join o_medians m on o.stage = m.stage where o.is_open)""",
    "o_step": """
select opp_id, case when is_open and close_date between date '2001-07-01' and date '2001-09-30' then
  case when next_step is null then 'no-next-step' when next_step_date < date '2001-08-02' then 'next-step-passed' end end as cause from opportunities""",
    "o_moved": """
select opp_id, day, stage, prev_amount as amount_before, amount, (amount - prev_amount)::double / prev_amount::double as moved_share
from o_hist where stage = prev_stage and abs((amount - prev_amount)::double / prev_amount::double) >= 0.2""",
    "o_replied": """
select opp_id, email, bool_or(case when direction is not null then direction in ('inbound', 'both') and subject not like 'Automatic reply%' end) as replied
from activity where opp_id is not null group by 1, 2""",
    "o_contacts": """
select coalesce(r.opp_id, a.opp_id) as opp_id, coalesce(r.email, a.email) as email,
  case when r.email is not null and a.email is not null then 'both' when r.email is not null then 'role-only' else 'activity-only' end as source,
  a.replied, case when a.replied is null then 'none' else 'logged direction' end as reply_evidence
from contact_roles r full join o_replied a on r.opp_id = a.opp_id and r.email = a.email""",
    "o_ghosts": """
select opp_id from contact_roles group by 1
having count(*) filter (not (opp_id % 9 = 0 and email not like 'ghost%') and email in (select email from o_replied x where x.opp_id = contact_roles.opp_id)) = 0""",
    "o_threading": """
select o.opp_id, case when people is null then 'no contacts loaded' when coalesce(directed, 0) = 0 then 'unknown' else 'known' end as state,
  concat_ws(',', case when directed > 0 and repliers = 1 and stage not in ('Qualify', 'Discovery') then 'single-threaded' end,
    case when directed > 0 and repliers = 0 and outbound > 0 then 'no-reply-ever' end, case when directed > 0 and inbound > 0 and inbound = machine then 'auto-reply-only' end) as flags,
  people, repliers, outbound, inbound
from opportunities o
left join (select opp_id, count(*) as people, count(*) filter (replied) as repliers from o_contacts group by 1) p on o.opp_id = p.opp_id
left join (select opp_id, count(*) filter (direction = 'outbound') as outbound, count(*) filter (direction = 'inbound') as inbound,
  count(*) filter (direction = 'inbound' and subject like 'Automatic reply%') as machine, count(direction) as directed from activity where opp_id is not null group by 1) t on o.opp_id = t.opp_id
where o.is_open""",
    "o_risks": """
select opp_id, stage, array_to_string(f, ',') as risk_flags, len(f) as severity from (
  select o.opp_id, o.stage, list_filter([case when p.close_date_pushes >= 3 then 'close-date-fictional' end, case when p.close_date_pushes = 2 then 'close-date-slipping' end,
    case when s.late_stage then 'stalled-late' end, case when s.stalled and not s.late_stage then 'stalled' end, case when t.flags like '%single-threaded%' then 'single-threaded' end,
    case when t.flags like '%no-reply-ever%' then 'no-reply-ever' end, case when g.opp_id is not null then 'ghost-roles' end, case when t.flags like '%auto-reply-only%' then 'auto-reply-only' end,
    case when n.cause = 'no-next-step' then 'no-next-step' end, case when n.cause = 'next-step-passed' then 'next-step-passed' end, case when m.opp_id is not null then 'amount-moved' end], lambda x: x is not null) as f
  from opportunities o left join o_pushes p on o.opp_id = p.opp_id left join o_stalled s on o.opp_id = s.opp_id left join o_threading t on o.opp_id = t.opp_id
  left join o_ghosts g on o.opp_id = g.opp_id left join o_step n on o.opp_id = n.opp_id left join (select distinct opp_id from o_moved) m on o.opp_id = m.opp_id where o.is_open)""",
    "o_eligible": """
select * from leads where not (direct_opt_out or bounced or left_company)
  and not (coalesce(in_sequence and sequence_next > date '2001-08-02', false) and not replied_to_sequence)""",
    "o_linked": """
select r.*, d.opp_id as renewal_opp_id, d.stage as renewal_opp_stage, d.created as renewal_opp_created, d.is_open as renewal_opp_open from renewals r left join (
  select renewal_id, o.opp_id, o.stage, o.created, o.is_open, row_number() over (partition by renewal_id order by o.created, o.opp_id) as rn
  from renewals c join opps_tracked o on c.account = o.account and o.track = 'renewal' and o.created > c.contract_start) d on r.renewal_id = d.renewal_id and d.rn = 1""",
    "o_renewal_flags": """
select *, array_to_string(f, ',') as risk_flags, len(f) as n_flags from (
  select r.renewal_id, r.account, r.owner, r.current_value, r.expansion_signal,
    case when first_touch is null and contract_end - lead_days < date '2001-08-02' then (date '2001-08-02' - (contract_end - lead_days))::bigint end as days_overdue,
    list_filter([case when renewal_opp_id is null then 'no-renewal-opp' end, case when first_touch is null and contract_end - lead_days < date '2001-08-02' then 'conversation-overdue' end,
      case when first_touch is null and contract_end - lead_days - date '2001-08-02' between 0 and 30 then 'conversation-due-soon' end,
      case when contract_end - notice_days - date '2001-08-02' between 0 and 30 then 'notice-window-closing' end, case when not champion_still_there then 'champion-left' end,
      case when last_qbr is null or last_qbr < date '2001-02-02' then 'no-qbr' end, case when date '2001-08-02' - a.last_day >= 60 then 'quiet' end,
      case when renewal_opp_open and proposed_value < current_value then 'contraction-risk' end], lambda x: x is not null) as f
  from o_linked r left join (select account, max(day) as last_day from raw_activity group by 1) a on r.account = a.account where status = 'Active')""",
    "o_valued": """
select r.*, cast(round(current_value * case when r.currency = 'USD' then cast(1 as decimal(18,8)) else s.rate end, 2) as decimal(18,2)) as cv,
  cast(round(proposed_value * case when r.currency = 'USD' then cast(1 as decimal(18,8)) else s.rate end, 2) as decimal(18,2)) as pv
from (select *, case when status <> 'Active' then least(contract_end, date '2001-08-02') else date '2001-08-02' end as rate_day from renewals) r
left join o_spans s on r.currency = s.currency and r.rate_day >= s.effective_from and (s.until is null or r.rate_day < s.until)""",
    "o_regs": """
select *, approved + protection_days as expires, 'acct' || customer || '.example.com' as customer_key, partner_id || '-' || customer || '-' || role as reg_id from registrations""",
    "o_live": "select * from o_regs where expires >= date '2001-08-02'",
    "o_subs": "select *, 'acct' || customer || '.example.com' as customer_key from submissions",
    "o_held": """
select customer_key, role as kind, partner_id from o_live union select customer_key, 'lapsed', partner_id from o_regs where expires < date '2001-08-02'""",
    "o_others": """
select s.submission_id, s.role, h.kind, s.customer_key || '/' || h.kind as detail, count(distinct h.partner_id) filter (h.partner_id <> s.partner_id) as others
from o_subs s join o_held h on s.customer_key = h.customer_key group by 1, 2, 3, 4""",
    "o_findings": """
select submission_id, 'same tier claimed' as finding, 'BLOCK' as severity, detail, others from o_others where kind = role and others > 0
union all select submission_id, 'role not permitted', 'BLOCK', role, null from o_subs s join partners p on s.partner_id = p.partner_id
  where roles_supported is not null and not list_contains(list_transform(string_split(roles_supported, ';'), lambda x: trim(x)), role)
union all select submission_id, 'direct opportunity', 'BLOCK', customer_key, null from o_subs where customer in (select account from opportunities where is_open and partner_id is null)
union all select submission_id, 'existing customer', 'CHECK', customer_key, null from o_subs where customer in (select account from opportunities where stage = 'Closed Won')
union all select *, null from o_territory
union all select submission_id, 'teaming', 'note', detail, others from o_others where kind <> role and kind <> 'lapsed' and others > 0
union all select submission_id, 'already holds this tier', 'note', s.role, null from o_subs s where exists (
  select 1 from o_live l where l.customer_key = s.customer_key and l.role = s.role and l.partner_id = s.partner_id)
union all select submission_id, 'expired claim', 'CHECK', detail, others from o_others where kind = 'lapsed' and others > 0""",
    "o_territory": """
with named as (select partner_id, unnest(string_split(named_accounts, ';')) as acct from partners),
f as (select s.*, p.partner_id is not null as known, exists (select 1 from named n where n.acct = s.customer::varchar and n.partner_id = s.partner_id) as mine,
    exists (select 1 from named n where n.acct = s.customer::varchar) as any_named,
    exists (select 1 from (select partner_id, trim(unnest(string_split(exclusive_territory, ';'))) as area from partners) x where x.area = s.country and x.partner_id <> s.partner_id) as excl,
    coalesce(not list_contains(string_split(p.countries, ';'), s.country), false) or coalesce(not list_contains(string_split(p.segments_served, ';'), s.segment), false)
      or coalesce(list_contains(string_split(p.excluded_accounts, ';'), s.customer::varchar), false) as outside
  from o_subs s left join partners p on s.partner_id = p.partner_id)
select submission_id, 'territory mismatch' as finding, 'CHECK' as severity, country || '/' || segment as detail from f where known and not mine and outside
union all select submission_id, 'exclusive territory', 'CHECK', country || '/' || segment from f where not mine and excl
union all select submission_id, 'named account of another', 'CHECK', country || '/' || segment from f where any_named and not mine""",
    "o_lone": """
select partner_id, min(owner) as owner, count(*) as deals from opportunities where partner_id is not null and owner is not null
group by 1 having count(distinct owner) = 1 and count(*) > 1""",
    "o_quote_totals": """
select quote_id, count(*) as lines, sum(extended)::decimal(18,2) as extended, round(sum((extended * discount)::decimal(18,4)), 2)::decimal(18,2) as discount_total,
  (sum(extended) - round(sum((extended * discount)::decimal(18,4)), 2))::decimal(18,2) as net,
  sum((extended * discount)::decimal(18,4))::decimal(20,4)::double / sum(extended)::double as blended_discount from quote_lines group by 1""",
    "o_groups": """
with s as (select source_value as sv, count(*) as n, count(detail) as d from campaigns group by 1)
select source_value, case when n > 1 and d = n then detail end as detail, min(campaign_id) as group_id, count(*) as campaigns, sum(cost)::decimal(18,2) as cost, min(started) as started,
  max(case when n > 1 and d = n then 'split by detail, approximate' when n > 1 then 'reported together' end) as split_note
from campaigns join s on source_value = sv group by 1, 2""",
    "o_funnel": """
with l as (select group_id, count(*) as leads, count(*) filter (not (direct_opt_out or bounced or left_company)) as leads_contactable, count(*) filter (status <> 'New') as leads_worked
  from leads join o_groups g on source = source_value and (g.detail is null or g.detail = source_detail) group by 1),
d as (select group_id, count(*) as opportunities, count(*) filter (is_open) as still_open, count(*) filter (stage = 'Closed Won') as won, coalesce(sum(converted_amount), 0)::decimal(18,2) as pipeline
  from o_conv join o_groups g on source = source_value and (g.detail is null or g.detail = source_detail) group by 1)
select g.group_id, campaigns, started, cost, split_note, coalesce(leads, 0) as leads, coalesce(leads_contactable, 0) as leads_contactable, coalesce(leads_worked, 0) as leads_worked,
  coalesce(opportunities, 0) as opportunities, coalesce(still_open, 0) as still_open, coalesce(won, 0) as won, pipeline from o_groups g left join l using (group_id) left join d using (group_id)""",
    "o_spellings": r"""
select * from (select competitor_id as term_id, trim(regexp_replace(lower(p), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) as phrase from (
  select competitor_id, name as p from competitors union select competitor_id, trim(unnest(string_split(aliases, ';'))) from competitors)) where phrase <> ''""",
    "o_notes": r"""
select opp_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g') || ' ' as padded from deal_notes""",
    "o_mentions": """
select distinct opp_id, term_id as competitor_id from o_notes join o_spellings on contains(padded, ' ' || phrase || ' ')""",
    "o_sig_pad": r"""
select signal_id, event_date, competitor_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g') || ' ' as padded from signals""",
    "o_hits": """
select distinct signal_id, watch_id from o_sig_pad join watchlist on contains(padded, ' ' || term || ' ') where kind not in ('Newsletter', 'Feed')""",
}
