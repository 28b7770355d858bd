"""Competitor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.functions.columns import word_tokens
from dealgrid.operators import competitors as cp
from dealgrid.operators.text_match import term_hits
from dealgrid.plans.q_scalars import distance_sql, words_sql
from dealgrid.plans.registry import Tables, query
from dealgrid.plans.views import AS_OF


def mentions(t: Tables):
    return cp.competitor_mentions(t.deal_notes, t.competitors).drop("sources")


@query("competitor_mentions", r"""
with terms as (select * from o_spellings where phrase not in ('erkeit')),
key as (select opp_id, trim(regexp_replace(lower(v), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) as value from (select opp_id, unnest(string_split(tech_stack, ';')) as v from deal_stack)),
hits as (select distinct opp_id, term_id, 'text' as source from o_notes join terms on contains(padded, ' ' || phrase || ' ')
  union select opp_id, term_id, 'picklist' from key join terms on value = phrase
  union select opp_id, term_id, 'loss reason' from (select opp_id, ' ' || regexp_replace(lower(loss_note), '[^\p{L}\p{M}\p{N}]+', ' ', 'g') || ' ' as padded from deal_stack) join terms on contains(padded, ' ' || phrase || ' '))
select opp_id, term_id as competitor_id, string_agg(source, ',' order by source) as sources from hits group by 1, 2""")
def _(t):
    stack = t.deal_stack
    return cp.competitor_mentions(
        t.deal_notes, t.competitors, exclude=["Erkeit"], stack=stack.select("opp_id", F.col("tech_stack").alias("value")), losses=stack.select("opp_id", F.col("loss_note").alias("text")))


@query("unknown_names", """
select 'partner ' || partner_id as name, count(*) as deals from opportunities where partner_id is not null and partner_id not in (select partner_id from partners) group by 1""")
def _(t):
    named = t.opportunities.select(F.when(F.col("partner_id").isNotNull(), F.concat(F.lit("partner "), F.col("partner_id"))).alias("name"))
    return cp.unknown_names(named, t.partners.select(F.concat(F.lit("partner "), F.col("partner_id")).alias("name")))


@query("competitor_signals", """
select signal_id, competitor_id, 'tagged' as basis from signals where competitor_id is not null
union all select distinct signal_id, term_id, 'to be tagged' from o_sig_pad join o_spellings on contains(padded, ' ' || phrase || ' ') where competitor_id is null""")
def _(t):
    return cp.competitor_signals(t.signals, t.competitors)


@query("competitor_displacement", """
select opp_id, o.account, case when runs_competitor is null then 'unknown' when runs_competitor then 'displacement' else 'greenfield' end as motion from opportunities o left join accounts a on o.account = a.account where is_open""")
def _(t):
    return cp.competitor_displacement(t.opportunities, t.accounts)


@query("competitor_record", """
select competitor_id, count(*) filter (stage = 'Closed Won') as won, count(*) filter (stage = 'Closed Lost') as lost, count(*) filter (is_open) as open_deals,
  case when count(*) filter (not is_open) >= 5 then count(*) filter (stage = 'Closed Won')::double / count(*) filter (not is_open) end as win_rate,
  case when count(*) filter (not is_open) < 5 then count(*) filter (stage = 'Closed Won') || ' of ' || count(*) filter (not is_open) end as sample_note
from o_mentions m join opportunities o on m.opp_id = o.opp_id group by 1""")
def _(t):
    return cp.competitor_record(mentions(t), t.opportunities)


@query("competitor_trend", """
with q as (select competitor_id, date_trunc('quarter', close_date)::date as quarter, count(*) filter (stage = 'Closed Won') as won, count(*) as decided
  from o_mentions m join opportunities o on m.opp_id = o.opp_id where not is_open group by 1, 2),
w as (select *, case when decided >= 5 then won::double / decided end as r, lag(case when decided >= 5 then won::double / decided end) over (partition by competitor_id order by quarter) as p from q)
select competitor_id, quarter::varchar as quarter, won, decided, case when r is null or p is null then 'Too few deals' when r > p then 'Up' when r < p then 'Down' else 'Flat' end as trend from w""")
def _(t):
    return cp.competitor_trend(mentions(t), t.opportunities)


@query("competitor_activity", """
select c.competitor_id, max(event_date)::varchar as last_signal_date, count(signal_id) filter (date '2001-08-02' - event_date <= 90) as signals_90d, count(signal_id) filter (event_date > researched) as signals_since_battlecard,
  (max(row(event_date, signal_id)))[2] as latest_signal, coalesce(string_agg(distinct case when event_date > researched and impact <> 'No impact' then impact end, ',' order by case when event_date > researched and impact <> 'No impact' then impact end), '') as open_impacts
from competitors c left join signals s on c.competitor_id = s.competitor_id group by 1""")
def _(t):
    return cp.competitor_activity(t.signals, t.competitors, AS_OF)


@query("open_impacts", """
select c.competitor_id, impact, count(*) as signals, max(event_date)::varchar as last_event from competitors c join signals s on c.competitor_id = s.competitor_id
where event_date > researched and impact <> 'No impact' group by 1, 2""")
def _(t):
    return cp.open_impacts(t.signals, t.competitors)


@query("stale_battlecards", """
select c.competitor_id, count(*) as signals_since, min(event_date)::varchar as first_event, max(event_date)::varchar as last_event, bool_or(impact = 'new capability') as voids_win_theme
from competitors c join signals s on c.competitor_id = s.competitor_id where tier = 'Primary' and event_date > researched group by 1""")
def _(t):
    return cp.stale_battlecards(t.competitors, t.signals)


@query("card_changes", """
select competitor_id, rank, signal_id, event_date::varchar as event_date, impact from (
  select c.competitor_id, signal_id, event_date, impact, row_number() over (partition by c.competitor_id order by event_date desc, signal_id) as rank
  from competitors c join signals s on c.competitor_id = s.competitor_id where event_date > researched)""")
def _(t):
    return cp.card_changes(t.signals, t.competitors)


@query("alias_candidates", f"""
with w as (select distinct unnest({words_sql('text')}) as seen from deal_notes)
select seen, phrase as candidate, {distance_sql('seen', 'phrase')} as distance from w join (select distinct phrase from o_spellings) on {distance_sql('seen', 'phrase')} <= 2
where seen not in (select phrase from o_spellings)""")
def _(t):
    words = t.deal_notes.select(F.explode(word_tokens(F.col("text"))).alias("name"))
    return cp.alias_candidates(words, t.competitors)


@query("competitor_first_seen", r"""
select opp_id, term_id as competitor_id, min(day)::varchar as first_seen from (
  select l.open_opp as opp_id, day, ' ' || regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g') || ' ' as padded from turns t join latest_open l on t.account = l.open_account)
join o_spellings on contains(padded, ' ' || phrase || ' ') group by 1, 2""")
def _(t):
    said = t.turns.join(t.latest_open, F.col("account") == F.col("open_account")).select(
        F.struct(F.col("open_opp").alias("opp_id"), "day").alias("k"), "text")
    hits = term_hits(said, "k", "text", cp.spellings(t.competitors)).select("k.opp_id", F.col("term_id").alias("competitor_id"), "k.day")
    return cp.competitor_first_seen(hits)


@query("rep_competitor_losses", """
with p as (select owner, competitor_id, count(*) as losses from o_mentions m join opportunities o on m.opp_id = o.opp_id where stage = 'Closed Lost' group by 1, 2)
select owner, competitor_id, losses, case when sum(losses) over (partition by owner) >= 5 then losses::double / (sum(losses) over (partition by owner))::double end as share,
  (sum(losses) over (partition by competitor_id))::double / (sum(losses) over ())::double as book_share from p""")
def _(t):
    return cp.rep_competitor_losses(mentions(t), t.opportunities)
