"""Quote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import quotes as qt
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF

STEPS = ((1, 100), (10, 95), (25, 88), (40, 80))


def tiers(t: Tables):
    return qt.tiers_of(t.price_list, STEPS)


@query("resolve_tier_price", """
select quote_id, line_no, l.sku, supp_no, l.qty, extended::double as extended, min_qty as tier_qty, price::double as unit_price from quote_lines l left join price_tiers p
on l.sku = p.sku and l.qty >= p.min_qty and not exists (select 1 from price_tiers x where x.sku = l.sku and x.min_qty <= l.qty and x.min_qty > p.min_qty)""")
def _(t):
    out = qt.resolve_tier_price(t.quote_lines, tiers(t))
    return out.select("quote_id", "line_no", "sku", "supp_no", "qty", "extended", "tier_qty", "unit_price")


@query("estimate_value", """
select quote_id, line_no, l.sku, supp_no, l.qty, (max_by(price, min_qty) filter (min_qty <= l.qty) * l.qty)::decimal(18,2)::double as estimate, (max(price) * l.qty)::decimal(18,2)::double as at_list,
  min(min_qty) filter (min_qty > l.qty) as next_qty, (max(price) filter (min_qty > l.qty))::double as next_price
from (select *, row_number() over () as rn from quote_lines) l join price_tiers p on l.sku = p.sku group by rn, 1, 2, 3, 4, 5""")
def _(t):
    return qt.estimate_value(t.quote_lines.select("quote_id", "line_no", "sku", "supp_no", "qty"), tiers(t))


@query("quote_guardrails", """
with l as (select q.*, p.price as unit_price from quote_lines q left join price_tiers p on q.sku = p.sku and q.qty >= p.min_qty
    and not exists (select 1 from price_tiers x where x.sku = q.sku and x.min_qty <= q.qty and x.min_qty > p.min_qty))
select quote_id, line_no, l.sku, supp_no, cast(unit_price * (1 - discount) as decimal(18,2))::double as net_price,
  concat_ws(',', case when p.sku is null then 'not on the list' end, case when qty < min_qty_sold then 'under minimum' end, case when qty % increment <> 0 then 'off increment' end,
    case when status = 'Deprecated' then 'price deprecated' end, case when expires < date '2001-08-02' then 'price expired' end, case when discount > 0 and discount_reason is null then 'discount without reason' end,
    case when cast(unit_price * (1 - discount) as decimal(18,2)) < floor_price then 'under floor' end) as problems
from l left join price_list p on l.sku = p.sku""")
def _(t):
    out = qt.quote_guardrails(t.quote_lines, t.price_list, tiers(t), AS_OF)
    return out.select("quote_id", "line_no", "sku", "supp_no", "net_price", "problems")


@query("quote_totals", "select quote_id, lines, extended::double as extended, discount_total::double as discount_total, net::double as net, blended_discount from o_quote_totals")
def _(t):
    return qt.quote_totals(t.quote_lines)


@query("quote_approval", """
with o as (select quote_id, count(*) filter (discount > max_discount) as n from quote_lines l left join price_list p on l.sku = p.sku group by 1)
select o.quote_id, n > 0 or blended_discount > 0.06 as needs_approval,
  concat_ws('; ', case when n > 0 then n || ' lines over the SKU limit' end, case when blended_discount > 0.06 then 'blended discount over the threshold' end) as approval_reason
from o join o_quote_totals t on o.quote_id = t.quote_id""")
def _(t):
    return qt.quote_approval(t.quote_lines, t.price_list)


@query("quote_versions", """
select quote_id, account, row_number() over w as version, lag(quote_id) over w as supersedes, case when lead(quote_id) over w is null then 'live' else 'superseded' end as status
from quotes window w as (partition by account order by issued, quote_id)""")
def _(t):
    return qt.quote_versions(t.quotes)


@query("quote_vs_opportunity", """
select t.quote_id, q.opp_id, net::double as net, amount::double as amount, q.currency as quote_currency, o.currency as deal_currency, q.currency = o.currency as same_currency,
  case when q.currency = o.currency then (net - amount)::double end as delta,
  case when q.currency <> o.currency then floor(net::double * rq.rate::double / ro.rate::double * 100 + 0.5)::bigint end as net_in_deal_currency_cents
from o_quote_totals t join quotes q on t.quote_id = q.quote_id join opportunities o on q.opp_id = o.opp_id
left join (select currency, rate from o_spans where until is null union all select 'USD', 1) rq on rq.currency = q.currency left join (select currency, rate from o_spans where until is null union all select 'USD', 1) ro on ro.currency = o.currency""")
def _(t):
    return qt.quote_vs_opportunity(qt.quote_totals(t.quote_lines), t.quotes, t.opportunities, t.fx_rates, AS_OF)


@query("quote_outcomes", """
select reason, count(*) as quotes, count(*) filter (outcome = 'Accepted') as accepted, case when count(*) >= 5 then count(*) filter (outcome = 'Accepted')::double / count(*) end as acceptance
from (select distinct quote_id, coalesce(discount_reason, 'none given') as reason from quote_lines where discount > 0) r join quotes q on r.quote_id = q.quote_id where outcome is not null group by 1""")
def _(t):
    return qt.quote_outcomes(t.quotes, t.quote_lines)


@query("always_discounted", "select sku, count(*) as lines, min(discount)::double as least from quote_lines group by 1 having min(discount) > 0")
def _(t):
    return qt.always_discounted(t.quote_lines)


@query("quotes_expiring", """
select quote_id, opp_id, valid_until::varchar as valid_until, (valid_until - date '2001-08-02')::bigint as days_left from quotes
where outcome is null and valid_until - date '2001-08-02' between 0 and 14 and opp_id not in (select related_id from tasks where status <> 'Done')""")
def _(t):
    return qt.quotes_expiring(t.quotes, t.tasks, AS_OF)


@query("quotes_lapsed", """
select sent_date is not null as was_sent, count(*) as quotes, max(date '2001-08-02' - valid_until)::bigint as longest_days from quotes
where outcome is null and valid_until < date '2001-08-02' and opp_id not in (select related_id from tasks where related_id % 3 <> 0) group by 1""")
def _(t):
    return qt.quotes_lapsed(t.quotes, t.tasks.withColumn("related_id", F.when(F.col("task_id") % 3 != 0, F.col("related_id"))), AS_OF)
