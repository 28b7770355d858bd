"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.functions import columns as fn
from dealgrid.functions import text as tx
from dealgrid.plans.registry import query

NORM_NAME = (
    r"nullif(array_to_string(list_filter(string_split_regex(lower({c}), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '' and w not in ("
    + ", ".join(f"'{w}'" for w in fn.COMPANY_NOISE) + ")), ' '), '')"
)
NORM_HOST = (
    r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), "
    r"'^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^.*@', ''), ':[0-9]+$', ''), '^www\.', ''), '')"
)
WORDS = r"list_filter(list_distinct(string_split_regex(lower({c}), '[^\p{L}\p{M}\p{N}]+')), lambda w: w <> '')"


# DuckDB measures edit distances in bytes: letters of several bytes that the tables hold get one each.
WIDE = "éèêëçôàâùûîïäöüßñóíáúновыйркмпаиятэл日本"
NARROW = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() or chr(c).isupper())[: len(WIDE)].replace("'", "''")


def distance_sql(a: str, b: str) -> str:
    """Edit distance in letters of two lower-case names."""
    return f"levenshtein(translate({a}, '{WIDE}', '{NARROW}'), translate({b}, '{WIDE}', '{NARROW}'))"


def norm_name_sql(column: str) -> str:
    return NORM_NAME.replace("{c}", column)


def norm_host_sql(column: str) -> str:
    return NORM_HOST.replace("{c}", column)


def words_sql(column: str) -> str:
    return WORDS.replace("{c}", column)


@query("norm_company", f"""
select signal_id, entity_name, {norm_name_sql("entity_name")} as company_key from signals""")
def _(t):
    return t.signals.select("signal_id", "entity_name", fn.norm_company(F.col("entity_name")).alias("company_key"))


@query("norm_domain", f"select page_id, url, {norm_host_sql('url')} as domain from pages")
def _(t):
    return t.pages.select("page_id", "url", fn.norm_domain(F.col("url")).alias("domain"))


@query("parse_mixed_date", """
select opp_id, created::varchar as parsed from opportunities where opp_id % 5 <> 4
union all select opp_id, null as parsed from opportunities where opp_id % 5 = 4""")
def _(t):
    created = F.col("created")
    dirty = (
        F.when(F.col("opp_id") % 5 == 4, F.lit("soon"))
        .when(F.col("opp_id") % 5 < 2, F.date_format(created, "M/d/yyyy"))
        .otherwise(F.concat(F.lit(" "), F.date_format(created, "yyyy-MM-dd")))
    )
    return t.opportunities.select("opp_id", fn.parse_mixed_date(dirty).alias("parsed"))


@query("parse_mixed_bool", """
select opp_id, case opp_id % 7 when 0 then true when 1 then true when 2 then true when 3 then false when 4 then false
  when 5 then false end as parsed from opportunities""")
def _(t):
    words = F.array(*[F.lit(w) for w in ("1", "TRUE", " yes", "0", "False", "no ", "maybe")])
    return t.opportunities.select(
        "opp_id", fn.parse_mixed_bool(F.get(words, (F.col("opp_id") % 7).cast("int"))).alias("parsed")
    )


@query("parse_money", """
select o_orderkey as opp_id, case when o_orderkey % 9 <> 8 then cast(o_totalprice as decimal(18,2))::double * case when o_orderkey % 9 in (2, 3) then -1 else 1 end end as amount
from orders""")
def _(t):
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    eu = F.translate(us, ",.", ".,")
    kind = F.col("o_orderkey") % 9
    shown = (
        F.when(kind == 8, F.lit("n/a")).when(kind == 2, F.concat(F.lit("("), us, F.lit(")"))).when(kind == 3, F.concat(F.lit("EUR "), eu, F.lit("-")))
        .when(kind == 4, F.concat(eu, F.lit(" €"))).otherwise(F.concat(F.lit("$ "), us))
    )
    return t.orders.select(F.col("o_orderkey").alias("opp_id"), fn.parse_money(shown).alias("amount"))


@query("norm_record_id", """
select o_orderkey as opp_id, '006' || lpad(o_orderkey::varchar, 12, '0') as short_id,
  '006Ab' || lpad(o_orderkey::varchar, 9, '0') || 'X' || 'IAQ' as long_id from orders""")
def _(t):
    short = F.concat(F.lit("006"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    seen = F.when(F.col("o_orderkey") % 2 == 0, F.concat(short, F.lit("QAB"))).otherwise(short)
    other = F.concat(F.lit("006Ab"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("X"))
    seen_other = F.when(F.col("o_orderkey") % 3 == 0, F.concat(other, F.lit("IAQ"))).otherwise(other)
    return t.orders.select(F.col("o_orderkey").alias("opp_id"), fn.norm_record_id(seen).alias("short_id"), fn.norm_record_id(seen_other, "long").alias("long_id"))


@query("format_local_id", """
select o_orderkey as opp_id, 'OPP-' || case when length(o_orderkey::varchar) < 4 then lpad(o_orderkey::varchar, 4, '0')
  else o_orderkey::varchar end as local_id from orders""")
def _(t):
    return t.orders.select(
        F.col("o_orderkey").alias("opp_id"), fn.format_local_id("OPP", 4, F.col("o_orderkey")).alias("local_id")
    )


@query("invert_rate", """
select currency, source, effective_from::varchar as effective_from,
  round(1000000 / units_per_base::double)::bigint as millionths from rate_feed""")
def _(t):
    return t.rate_feed.select(
        "currency", "source", "effective_from",
        F.round(fn.invert_rate(F.col("units_per_base")) * 1000000).cast("long").alias("millionths"),
    )


@query("fiscal_quarter", """
select opp_id, (date_trunc('month', close_date)::date - to_months((month(close_date) - 2 + 12) % 3))::date::varchar as quarter_start,
  ((date_trunc('month', close_date)::date - to_months((month(close_date) - 2 + 12) % 3) + to_months(3))::date - 1)::varchar as quarter_end
from opportunities""")
def _(t):
    quarter = fn.fiscal_quarter(F.col("close_date"), 2)
    return t.opportunities.select("opp_id", quarter["start"].alias("quarter_start"), quarter["end"].alias("quarter_end"))


@query("days_and_months", """
select opp_id, (close_date - date '2001-08-02')::bigint as days_to_close,
  greatest(date '2001-08-02' - close_date, 0)::bigint as days_late,
  (case when created <= date '2001-08-02' then
    datediff('month', created, date '2001-08-02') - case when day(created) > 2 and not (day(created) = day(last_day(created)) and false) then 1 else 0 end
   end)::bigint as whole_months
from opportunities""")
def _(t):
    as_of = F.lit("2001-08-02").cast("date")
    return t.opportunities.select(
        "opp_id",
        fn.days_to(F.col("close_date"), as_of).alias("days_to_close"),
        fn.days_overdue(F.col("close_date"), as_of).alias("days_late"),
        fn.whole_months_since(F.col("created"), as_of).alias("whole_months"),
    )


@query("split_list", """
select partner_id, array_to_string(list_transform(string_split(roles_supported, ';'), lambda x: trim(x)), ',') as roles from partners
where roles_supported is not null
union all select partner_id, '' as roles from partners where roles_supported is null""")
def _(t):
    roles = fn.split_list(F.col("roles_supported"))
    return t.partners.select("partner_id", F.coalesce(roles, F.array().cast("array<string>")).alias("roles"))


@query("list_permits", """
select partner_id, roles_supported is null or roles_supported like '%Distributor%' as may_distribute from partners""")
def _(t):
    return t.partners.select(
        "partner_id",
        fn.list_permits(fn.split_list(F.col("roles_supported")), F.lit("Distributor")).alias("may_distribute"),
    )


@query("auto_reply_match", """
select activity_id, regexp_matches(lower(subject), 'automatic reply|out of office|undeliverable|delivery status notification') as machine
from activity""")
def _(t):
    return t.activity.select("activity_id", fn.auto_reply_match(F.col("subject")).alias("machine"))


@query("alias_match", r"""
select note_id, regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}])(thatin|orantion)($|[^\p{L}\p{M}\p{N}])') as named from deal_notes""")
def _(t):
    return t.deal_notes.select(
        "note_id", fn.alias_match(F.col("text"), F.array(F.lit("Thatin"), F.lit("ORANTION"))).alias("named")
    )


@query("guarded_rate", """
select account, case when count(*) >= 5 then count(*) filter (stage = 'Closed Won') / count(*)::double end as win_rate
from opportunities where not is_open group by 1""")
def _(t):
    won = F.count_if(F.col("stage") == "Closed Won")
    return (
        t.opportunities.filter(~F.col("is_open")).groupBy("account")
        .agg(fn.guarded_rate(won, F.count(F.lit(1))).alias("win_rate"))
    )


@query("sample_note", """
select account, case when count(*) < 5 then (count(*) filter (stage = 'Closed Won')) || ' of ' || count(*) end as note
from opportunities where not is_open group by 1""")
def _(t):
    won = F.count_if(F.col("stage") == "Closed Won")
    return (
        t.opportunities.filter(~F.col("is_open")).groupBy("account")
        .agg(fn.sample_note(won, F.count(F.lit(1))).alias("note"))
    )


@query("reason_text", """
select opp_id, 'Deal ' || opp_id || ' - close date passed ' || (date '2001-08-02' - close_date) || ' days ago' as reason
from opportunities where is_open and close_date < date '2001-08-02'""")
def _(t):
    late = F.datediff(F.lit("2001-08-02").cast("date"), F.col("close_date"))
    return t.opportunities.filter(F.col("is_open") & (late > 0)).select(
        "opp_id",
        fn.reason_text(F.concat(F.lit("Deal "), F.col("opp_id")), "close date passed", late, "days ago").alias("reason"),
    )


@query("account_slug", r"""
select signal_id, event_date::varchar || '-' || regexp_replace(regexp_replace(lower(entity_name), '[^\p{L}\p{M}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug
from signals""")
def _(t):
    return t.signals.select("signal_id", fn.account_slug(F.col("event_date"), F.col("entity_name")).alias("slug"))


@query("json_extract", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def _(t):
    return t.events.select("event_id", fn.json_extract(F.col("props"), "$.k").cast("long").alias("k"))


@query("phrase_search", """
select meeting_id, turn, role as speaker, day::varchar as day, text as quote, 'turn' as found_in from turns where contains(lower(text), 'the th')
union all select meeting_id, null, null, day::varchar, summary, 'summary' from meetings where contains(lower(summary), 'the th')
union all select meeting_id, null, null, day::varchar, key_quote, 'key_quote' from meetings where contains(lower(key_quote), 'the th')""")
def _(t):
    return tx.phrase_search(t.turns, "the th", t.meetings)


EDGE = r"[^\p{L}\p{M}\p{N}]"


@query("commitment_extract", rf"""
select meeting_id, turn, role as speaker, case when role = 'assistant' then 'ours' else 'theirs' end as direction, text as quote, due_words, due_words is null as needs_review
from (select *, nullif(regexp_extract(lower(text), '(by|until) (monday|tuesday|wednesday|thursday|friday|tomorrow|next week|end of [a-z]+)', 2), '') as due_words from spoken)
where role <> 'system' and regexp_matches(lower(text), '(^|{EDGE})(i will|i''ll|we will|we''ll|i can get|we can send|let me send)($|{EDGE})')""")
def _(t):
    return tx.commitment_extract(t.spoken)


def _tag_sql(tag: str, wording: str) -> str:
    return f"select meeting_id, turn, role as speaker, '{tag}' as tag, text as quote from spoken where regexp_matches(lower(text), '(^|{EDGE})({wording})($|{EDGE})')"


@query("signal_phrases", " union all ".join((
    _tag_sql("risk", "no budget|on hold|blocking|blocker|not a priority|legal concern"), _tag_sql("positive", "exactly what we|my vp|love this|looking forward"),
    _tag_sql("churn", "consolidating|consolidation|unused seats|budget review|cancel"), _tag_sql("expansion", "more seats|another team|roll out|additional licences"))))
def _(t):
    return tx.signal_phrases(t.spoken)
