"""Refresh, drift, push and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealgrid.operators import quotes, sync
from dealgrid.plans.common import STAGES
from dealgrid.plans.q_forecast import stage_rank_sql
from dealgrid.plans.registry import query
from dealgrid.plans.views import AS_OF

FIELDS = ("owner", "amount", "stage", "close_date")


def drift_sql(field: str, kind: str, local: str = "opp_local") -> str:
    return f"""select opp_id, '{field}' as field, case when l.{field} is not distinct from s.{field} then 'IN-SYNC' when l.{field} is not distinct from b.{field} then 'DRIFT'
  when s.{field} is not distinct from b.{field} then 'AHEAD' else 'CONFLICT' end as sync_class, l.{field}::varchar as local_value, s.{field}::varchar as source_value
from ids left join {local} l using (opp_id) left join opp_cur s using (opp_id) left join opp_prev b using (opp_id)"""


def loose_sql(field: str) -> str:
    """Rows that no other side knows."""
    return f"select null, '{field}', case when {field} is null then 'IN-SYNC' else 'AHEAD' end, {field}::varchar, null from opp_loose where opp_id is null"


@query("verify_sync", """
with local as (select * from (select *, row_number() over (partition by opp_id order by amount desc) as rn, count(*) over (partition by opp_id) as n from opp_loose where opp_id is not null) where rn = 1),
ids as (select opp_id from local union select opp_id from opp_cur union select opp_id from opp_prev)
""" + "\nunion all ".join([*(drift_sql(f, "", "local") for f in FIELDS), *map(loose_sql, FIELDS)]) + """
union all select opp_id, '(record)', 'DUPLICATE', n::varchar, case when opp_id in (select opp_id from opp_cur) then '1' else '0' end from local where n > 1""")
def _(t):
    return sync.verify_sync(t.opp_loose, t.opp_cur, t.opp_prev, "opp_id", FIELDS)


@query("refresh_merge", """
select coalesce(l.opp_id, s.opp_id) as opp_id, case when s.opp_id is not null then s.owner else l.owner end as owner,
  (case when s.opp_id is not null then s.amount else l.amount end)::double as amount, case when s.opp_id is not null then s.stage else l.stage end as stage,
  l.close_date::varchar as close_date, l.notes, l.local_id
from opp_local l full join opp_cur s on l.opp_id = s.opp_id""")
def _(t):
    local = t.opp_local.select("opp_id", "owner", "amount", "stage", "close_date", "notes", "local_id")
    return sync.refresh_merge(local, t.opp_cur, "opp_id", {"owner": "crm", "amount": "crm", "stage": "crm", "close_date": "local", "notes": "local"})


CRM_KEY = "'00' || opp_id % 10 || 'b' || opp_id"


@query("upsert_by_key", f"""
with local as (select {CRM_KEY} as crm_key, opp_id + 100 as local_no, amount, stage from opp_prev),
incoming as (select case when opp_id % 29 = 0 then null else {CRM_KEY} end as crm_key, amount, stage from opp_cur),
fresh as (select *, row_number() over (order by crm_key nulls first, amount, stage) as n from incoming where crm_key is null or crm_key not in (select crm_key from local))
select l.local_no, l.crm_key, coalesce(c.amount, l.amount)::double as amount, coalesce(c.stage, l.stage) as stage from local l left join incoming c on l.crm_key = c.crm_key
union all select (select max(local_no) from local) + n, crm_key, amount::double, stage from fresh""")
def _(t):
    local = t.opp_prev.select((F.col("opp_id") + 100).alias("local_no"), F.expr(CRM_KEY).alias("crm_key"), "amount", "stage")
    key = F.when(F.col("opp_id") % 29 != 0, F.expr(CRM_KEY))
    incoming = t.opp_cur.select(key.alias("crm_key"), "amount", "stage")
    # Older copies of a third of the rows come along.
    older = t.opp_cur.filter("opp_id % 3 = 0 and opp_id % 29 <> 0").select(key.alias("crm_key"), (F.col("amount") - 1).cast("decimal(18,2)").alias("amount"), "stage")
    return sync.upsert_by_key(local, incoming.unionByName(older), "crm_key", "local_no")


@query("push_diff", """
select opp_id, 'amount' as field, s.amount::varchar as current, l.amount::varchar as proposed, 'safe' as push_class, null as reason
from opp_local l join opp_prev s using (opp_id) where l.amount is distinct from s.amount
union all select opp_id, 'stage', s.stage, l.stage, 'needs approval', 'starts an approval' from opp_local l join opp_prev s using (opp_id) where l.stage is distinct from s.stage""")
def _(t):
    local = t.opp_local.select("opp_id", "amount", "stage", "owner", "notes")
    return sync.push_diff(
        local, t.opp_prev, "opp_id", {"amount": "safe", "stage": "needs approval"}, {"stage": "starts an approval"}
    )


@query("approval_triggers", f"""
with b as (select l.opp_id, l.stage as new_stage, l.amount as new_amount, s.stage as old_stage, s.amount as old_amount, q.blended_discount as discount
  from opp_prev l join opportunities s using (opp_id) left join o_quote_totals q on q.quote_id = l.opp_id)
select opp_id, 'discount over limit' as trigger, old_stage, new_stage from b where discount > 0.08
union all select opp_id, 'amount drop', old_stage, new_stage from b where (old_amount - new_amount)::double / old_amount::double > 0.1
union all select opp_id, 'stage moved back', old_stage, new_stage from b where {stage_rank_sql('new_stage')} < {stage_rank_sql('old_stage')}""")
def _(t):
    offered = quotes.quote_totals(t.quote_lines).select(F.col("quote_id").alias("opp_id"), F.col("blended_discount").alias("discount"))
    return sync.approval_triggers(t.opp_prev.join(offered, "opp_id", "left"), t.opportunities, "opp_id", STAGES)


@query("reconcile_three_way", """
with k as (select obj from manifest_new union select obj from manifest_cur),
j as (select k.obj, n.section, n.hash as n, c.hash as c, b.hash as b, d.hash as d from k left join manifest_new n using (obj) left join manifest_cur c using (obj)
  left join manifest_base b using (obj) left join manifest_disk d using (obj))
select obj, case when n is null then 'GONE' when c is null then 'ADD' when c = n then 'SAME' when c = d and b = n then 'SAME' when section = 'src9' then 'UPDATE'
    when c = b then 'UPDATE' when section in ('src1', 'src2', 'src3', 'src4') then 'MERGE' else 'KEEP' end as action,
  case when n is null then 'not in the new set' when c is null then 'not present yet' when c = n then 'identical' when c = d and b = n then 'settled earlier' when section = 'src9' then 'metadata'
    when c = b then 'untouched here' when b is null then 'no baseline' else 'edited here' end as why
from j""")
def _(t):
    return sync.reconcile_three_way(
        t.manifest_new, t.manifest_cur, t.manifest_base, t.manifest_disk, "obj",
        mergeable=F.col("section").isin("src1", "src2", "src3", "src4"), metadata=F.col("section") == "src9",
    )


@query("write_guard", """
with b as (select opp_id, case when opp_id % 19 = 0 then 'local ' || opp_id else 'C' || opp_id end as sid, created as m from opportunities),
a as (select case when opp_id % 101 = 0 then opp_id + 1 else opp_id end as opp_id, case when opp_id % 19 = 0 then 'local ' || case when opp_id % 101 = 0 then opp_id + 1 else opp_id end else 'C' || opp_id end as sid, case when opp_id % 77 = 0 then created - 3 else created end as m from opportunities where stage <> 'Closed Lost'),
c as (select count(b.opp_id) as n_rows, count(*) filter (a.opp_id is null) as lost, count(*) filter (a.m < b.m) as reverted, count(*) filter (a.opp_id <> b.opp_id) as renumbered from b full join a using (sid))
select 'rows lost' as "check", lost as n, lost <= n_rows * 0.1 as ok from c union all select 'edits reverted', reverted, reverted = 0 from c union all select 'ids renumbered', renumbered, renumbered = 0 from c""")
def _(t):
    before = t.opportunities.select("opp_id", F.when(F.col("opp_id") % 19 != 0, F.concat(F.lit("C"), F.col("opp_id"))).alias("sid"), F.col("created").alias("m"), "stage")
    oid = F.col("opp_id")
    after = before.filter("stage <> 'Closed Lost'").select(
        F.when(oid % 101 == 0, oid + 1).otherwise(oid).alias("opp_id"), "sid",
        F.when(oid % 77 == 0, F.date_sub("m", 3)).otherwise(F.col("m")).alias("m"),
    )
    return sync.write_guard(before, after, "opp_id", "sid", "m")


@query("latest_record", """
select opp_id, day::varchar as day, line, part_no, supp_no, stage, close_date::varchar as close_date, amount::double as amount, currency from (
  select *, row_number() over (partition by opp_id order by day desc, line desc, part_no desc, supp_no desc, close_date desc, amount desc) as rn
  from (select * replace (case when part_no % 50 = 0 then null else opp_id end as opp_id) from opp_history)) where rn = 1 or opp_id is null""")
def _(t):
    feed = t.opp_history.withColumn("opp_id", F.when(F.col("part_no") % 50 != 0, F.col("opp_id")))
    return sync.latest_record(feed, "opp_id", ["day", "line", "part_no", "supp_no", "close_date", "amount"])


@query("schema_merge", """
with j as (select coalesce(l.registry, n.registry) as registry, coalesce(l.column_name, n.column_name) as column_name, l.column_no as ln, n.column_no as nn, l.column_type as lt, n.column_type as nt,
    l.enum_values as lv, n.enum_values as nv, l.owner as lo, n.owner as no_, l.verify as lver, n.verify as nver, coalesce(n.owner_corrected, false) as fix, coalesce(n.verify_corrected, false) as vfix
  from schema_local l full join schema_new n on l.registry = n.registry and l.column_name = n.column_name),
x as (select *, case when lt = 'enum' and nt = 'enum' then list_filter(string_split(lv, ';'), lambda v: not list_contains(string_split(nv, ';'), v)) else [] end as extra,
  coalesce(nn is not null and ln is not null and lo <> no_, false) as odiff, coalesce(nn is not null and ln is not null and lver <> nver, false) as vdiff,
  nn is not null and ln is not null and lo is not null and no_ is null as olost from j)
select registry, column_name, coalesce(nt, lt) as column_type, case when nn is null then lv when len(extra) > 0 then nv || ';' || array_to_string(extra, ';') else nv end as enum_values,
  case when nn is null or (odiff and not fix) then lo else no_ end as owner, case when nn is null or (vdiff and not vfix) then lver else nver end as verify, nn is null as at_end, coalesce(nn, ln) as column_no,
  array_to_string(list_filter([case when len(extra) > 0 then 'kept extra values' end, case when odiff and not fix then 'kept owner' end, case when odiff and fix then 'corrected owner' end,
    case when olost then 'owner lost' end, case when vdiff and not vfix then 'kept verify' end, case when vdiff and vfix then 'corrected verify' end, case when nn is not null and ln is not null and lver is not null and nver is null then 'verify lost' end, case when ln is null then 'new column' end, case when nn is null then 'kept user column' end], lambda v: v is not null), ',') as notes
from x""")
def _(t):
    return sync.schema_merge(t.schema_local, t.schema_new)


@query("settings_merge", """
select coalesce(l.registry, n.registry) as registry, coalesce(l.setting, n.setting) as setting,
  case when n.registry is null or (l.registry is not null and l.value <> n.value and l.setting in ('archive', 'path', 'id_prefix', 'id_width')) then l.value else n.value end as value,
  case when n.registry is null then 'kept your setting' when l.registry is null then 'new setting' when l.value <> n.value and l.setting in ('archive', 'path', 'id_prefix', 'id_width') then 'kept your value' end as note
from settings_local l full join settings_new n on l.registry = n.registry and l.setting = n.setting""")
def _(t):
    return sync.settings_merge(t.settings_local, t.settings_new)


@query("migrate_registry", """
select opp_id, account, amount::double as amount, null::varchar as renewal_region, null::double as discount_pct, stage from opp_prev""")
def _(t):
    old = t.opp_prev.select("stage", "amount", "account", "opp_id")
    return sync.migrate_registry(
        old, {"opp_id": "bigint", "account": "bigint", "amount": "decimal(18,2)", "renewal_region": "string", "discount_pct": "double"}
    )


@query("dropped_keys", "select opp_id from opp_prev where opp_id not in (select opp_id from opp_cur)")
def _(t):
    return sync.dropped_keys(t.opp_prev, t.opp_cur, "opp_id")


@query("changes_between", """
select entry_id, version::varchar as version, body from change_log where version > date '2000-01-01' and version <= date '2001-01-01' and trim(body) <> ''""")
def _(t):
    return sync.changes_between(t.change_log, "2000-01-01", "2001-01-01")


@query("drift_trend", """
select field, day::varchar as day, from_value, to_value, count(*) as rows, count(*) filter (drift_class = 'AHEAD' and day <= date '2001-08-02' - 7) as ahead_too_long
from drift_log group by 1, 2, 3, 4""")
def _(t):
    return sync.drift_trend(t.drift_log, AS_OF)


@query("unassigned_records", """
select 'opportunity' as kind, opp_id as record_id, owner from opportunities where owner is null or owner not in (select rep from team)
union all select 'renewal', renewal_id, owner from renewals where owner is null or owner not in (select rep from team)
union all select 'lead', lead_id, owner from leads where owner is null or owner not in (select rep from team)""")
def _(t):
    return sync.unassigned_records({"opportunity": t.opportunities, "renewal": t.renewals, "lead": t.leads}, t.team)


@query("drift_changes_actor", """
select activity_id, a.opp_id, actor, kind, day::varchar as day from activity a join opportunities o on a.opp_id = o.opp_id
where o.is_open and o.owner = 7 and actor <> 7 and day >= date '2001-07-25'""")
def _(t):
    return sync.drift_changes_actor(t.activity, t.opportunities, 7, "2001-07-25")
