"""Currency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import fx
from dealgrid.plans.common import converted
from dealgrid.plans.registry import query
from dealgrid.plans.views import AS_OF


@query("fx_convert", """
select opp_id, currency, rate_used::double as rate_used, converted_amount::double as converted_amount, not is_open as frozen from o_conv""")
def _(t):
    return converted(t).select("opp_id", "currency", "rate_used", "converted_amount", "frozen")


@query("unconverted_report", """
select opp_id, currency, case when currency = 'CHF' then 'no rate for currency' else 'no rate that early' end as reason
from o_conv where converted_amount is null""")
def _(t):
    return fx.unconverted_report(converted(t), t.fx_rates, "opp_id")


@query("fx_drift", """
select currency, crm_rate::double as crm_rate, market_rate::double as market_rate,
  (crm_rate - market_rate)::double / market_rate::double as drift, abs((crm_rate - market_rate)::double / market_rate::double) > 0.02 as beyond_limit
from (select currency, max(rate) filter (source = 'crm') as crm_rate, max(rate) filter (source = 'market') as market_rate
  from (select currency, source, max_by(cast(round(1 / units_per_base::double, 8) as decimal(18,8)), effective_from) as rate from rate_feed group by 1, 2) group by 1)""")
def _(t):
    return fx.fx_drift(fx.load_rates(t.rate_feed), AS_OF)


@query("fx_staleness", """
select currency, (date '2001-08-02' - max(effective_from))::bigint as age_days, date '2001-08-02' - max(effective_from) > 1 as stale
from rate_feed group by 1""")
def _(t):
    return fx.fx_staleness(fx.load_rates(t.rate_feed), AS_OF, days=1)


@query("latest_rate", """
select currency, source, max(effective_from)::varchar as effective_from,
  max_by(cast(round(1 / units_per_base::double, 8) as decimal(18,8)), effective_from)::double as rate from rate_feed
where effective_from <= date '2001-08-02' group by 1, 2""")
def _(t):
    return fx.latest_rate(fx.load_rates(t.rate_feed), AS_OF)


@query("currency_mix", """
select currency, count(*) as records, count(*) filter (converted_amount is null) as unconverted from o_conv group by 1""")
def _(t):
    return fx.currency_mix(converted(t))


@query("freeze_on_close", """
with firsts as (
  select * from (select *, row_number() over (partition by opp_id order by day, line, part_no, supp_no, close_date, amount) as rn
    from opp_history where stage like 'Closed%') where rn = 1)
select opp_id, day::varchar as closed_on, stage as closed_stage, f.currency,
  cast(round(amount * case when f.currency = 'USD' then 1::decimal(18,8) else r.rate end, 2) as decimal(18,2))::double as frozen_amount
from firsts f left join o_spans r on f.currency = r.currency and f.day >= r.effective_from and (r.until is null or f.day < r.until)""")
def _(t):
    return fx.freeze_on_close(t.opp_history, t.fx_rates)


@query("fx_volume_split", """
with b as (select currency, sum(amount) as x from opp_prev where is_open group by 1), c as (select currency, sum(amount) as x from opp_cur where is_open group by 1),
r as (select currency, max(rate) filter (effective_from = date '1998-01-01') as r0, max(rate) filter (effective_from = date '2000-06-01') as r1
  from fx_rates where source = 'crm' group by 1 union all select 'USD', 1::decimal(18,8), 1::decimal(18,8))
select coalesce(b.currency, c.currency) as currency,
  cast(round((coalesce(c.x, 0) - coalesce(b.x, 0))::decimal(18,2) * r0, 2) as decimal(18,2))::double as from_deals,
  cast(round(coalesce(c.x, 0)::decimal(18,2) * (r1 - r0)::decimal(18,8), 2) as decimal(18,2))::double as from_rates
from b full join c on b.currency = c.currency left join r on r.currency = coalesce(b.currency, c.currency)""")
def _(t):
    return fx.fx_volume_split(t.opp_prev, t.opp_cur, t.fx_rates, "1999-01-01", AS_OF)


@query("read_fx_rates", """
select currency, source, effective_from::varchar as effective_from, round(1000000 / units_per_base::double)::bigint as millionths from rate_feed""")
def _(t):
    from dealgrid.session import shared_folder
    from dealgrid.sources import readers

    path = shared_folder(t.spark, "rate-feed")
    # The market publishes per unit, the crm units per base.
    market = F.col("source") == "market"
    shown = F.when(market, F.round(F.lit(1.0) / F.col("units_per_base").cast("double"), 8)).otherwise(F.col("units_per_base").cast("double"))
    feed = t.rate_feed.groupBy("source", "effective_from").agg(F.map_from_entries(F.collect_list(F.struct("currency", shown))).alias("rates"))
    feed.select(
        F.lit("USD").alias("base"), F.when(market, "base-per-unit").otherwise("units-of-currency-per-base").alias("convention"), "rates", "source", "effective_from"
    ).write.json(path)
    rates = readers.read_fx_rates(t.spark, path)
    return rates.select("currency", "source", "effective_from", F.round(F.col("rate") * 1000000).cast("long").alias("millionths"))
