"""Registered queries of the corpus operators, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.llm import exact_dedup, fingerprints, hard_negatives, lm_scoring, manifest, mixing, near_dedup, quality, substring_dedup, subword, token_counts, url_filter, warc
from dealgrid.llm.common import table
from dealgrid.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Verdict and rule, host and path as one.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Target weights of the sources; those not named weigh 1.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5, "src3": 0.0}
MIX_EPOCHS = 1.0
MIX_SEED = 17


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_RULE_SQL = " ".join(
    f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
    for _, r in sorted(URL_RULES, key=lambda x: -len(x[1]))
)
_BLOCKED = ", ".join(f"'{r}'" for v, r in URL_RULES if v == "block")

URL_SQL = rf"""
with recursive parsed as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '(?i)(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') as q
  from pages),
ruled as (
  select *, case {_RULE_SQL} end as rule,
    case when contains(url, '://') then regexp_replace(host, ':(80|443)$', '') || case when path = '' then '/' else path end || case when q <> '' then '?' || q else '' end end as node
  from parsed),
blocked as (select distinct node from ruled where rule in ({_BLOCKED}) and node is not null)
select page_id, host, path, rule,
  case when rule in ({_BLOCKED}) then 'block' when rule is not null then 'allow'
       when node in (select node from blocked) then 'block' else 'allow' end as verdict
from ruled
"""


@query("op1_url_alias_filter", URL_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op2_quality_ranking")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), quality.training_rows(F.col("doc_id")))
    scored = quality.score_quality(docs, ranker)
    return scored.select("doc_id", (~quality.training_rows(F.col("doc_id"))).alias("held_out"), "score", "predicted")


_WEIGHT_SQL = " ".join(f"when '{k}' then {v}" for k, v in SOURCE_WEIGHTS.items())

MIX_SQL = f"""
with stats as (
  select coalesce(source, '') as s, sum(coalesce(length(text), 0) + 1) as chars, case coalesce(source, '') {_WEIGHT_SQL} else 1.0 end as weight
  from documents group by 1, 3),
rates as (select s, {MIX_EPOCHS} * sum(chars) over () / sum(weight) over () * weight / chars as rate from stats),
steps as (
  select s, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) as p
  from (select s, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint)) as k from rates where rate > 0)),
cdf as (select s, k, sum(p) over (partition by s order by k) as c from steps),
draws as (
  select *, coalesce(source, '') as s, (('0x' || substr(md5('{MIX_SEED}:' || doc_id), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u from documents),
counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) as copies
  from draws d join cdf on d.s = cdf.s and cdf.c < d.u group by all)
select doc_id, text, lang, source, n_chars, replica::int as replica, md5('{MIX_SEED}:' || doc_id || ':' || replica) as shuffle_key
from (select *, unnest(generate_series(1, copies)) as replica from counted)
"""


@query("op3_poisson_mixing", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, epochs=MIX_EPOCHS, seed=MIX_SEED)


WARC_SQL = """
with digests as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
named as (
  select *, max(page_id) over (partition by h) as newest,
    list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), 'string_agg', '') as payload_digest
  from digests)
select page_id, payload_bytes, payload_digest, case when page_id = newest then 'response' else 'revisit' end as record_type,
  case when page_id <> newest then newest end as refers_to, 'ok' as status
from named
"""


@query("op4_warc_segments", WARC_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


@query("op5_trie_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op6_context_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""


@query("op7_block_naming", EXACT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op8_iblt_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(table(spark, sf_dir, "documents"))


@query("op9_merge_dropout")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.encode(table(spark, sf_dir, "documents"))


@query("op10_odd_sketch_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, threshold=0.8).drop("text_key")


NEGATIVES_SQL = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
numbered as (select *, row_number() over () as rid from v),
scored as (
  select a.rid as aid, a.vec_id as anchor_id, r.rid, r.vec_id, r.label = a.label as alike, list_inner_product(a.vec, r.vec)::bigint as score
  from numbered a join numbered r on a.vec_id % 100 = 0 and r.rid <> a.rid),
positives as (
  select aid, anchor_id, rid as pid, vec_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by aid order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over w::int as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.aid = p.aid and not n.alike and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
window w as (partition by p.aid, p.pid order by n.score desc, n.vec_id)
qualify row_number() over w <= 10
"""


@query("op11_multi_index_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", shifted))


_FIELDS_SQL = " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT_SQL = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 bit by bit over the characters of a decimal number.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))))"""
_SIDES_SQL = """
  select *, coalesce(string_agg(digest, '') over (partition by k, lvl, pos // 16 order by pos rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(digest, '') over (partition by k, lvl, pos // 16 order by pos rows between 1 following and unbounded following), '') as r
  from {0} where total > 1"""

MANIFEST_SQL = f"""
with recursive base as (
  select doc_id, coalesce('=' || source, '') as k, sha256({_FIELDS_SQL} || {_TEXT_SQL.format("text")}) as leaf,
    case when {_CRC_SQL} % 5 = 0 then sha256({_FIELDS_SQL} || {_TEXT_SQL.format(_LOWER_SQL)}) end as tampered
  from documents),
placed as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as total from base),
nodes as (
  select k, pos, total, leaf as digest, 0 as lvl from placed
  union all
  select k, pos // 16, (total + 15) // 16, sha256(string_agg(digest, '' order by pos)), lvl + 1 from nodes where total > 1 group by k, pos // 16, total, lvl),
sides as materialized ({_SIDES_SQL.format("nodes")}),
tops as (select k as source, digest, row_number() over (order by k) - 1 as pos, count(*) over () as total from nodes where total = 1),
upper_nodes as (
  select '' as k, pos, total, digest, 0 as lvl from tops
  union all
  select k, pos // 16, (total + 15) // 16, sha256(string_agg(digest, '' order by pos)), lvl + 1 from upper_nodes where total > 1 group by k, pos // 16, total, lvl),
upper_sides as materialized ({_SIDES_SQL.format("upper_nodes")}),
folded as (
  select doc_id, k, leaf, pos, total, 0 as lvl, '' as proof, coalesce(tampered, leaf) as x from placed
  union all
  select f.doc_id, f.k, f.leaf, f.pos // 16, (f.total + 15) // 16, f.lvl + 1, f.proof || s.l || s.r, sha256(s.l || f.x || s.r)
  from folded f join sides s on s.k = f.k and s.lvl = f.lvl and s.pos = f.pos where f.total > 1),
risen as (
  select f.doc_id, f.leaf, t.digest as subroot, t.pos, t.total, 0 as lvl, f.proof, f.x from folded f join tops t on t.source = f.k where f.total = 1
  union all
  select f.doc_id, f.leaf, f.subroot, f.pos // 16, (f.total + 15) // 16, f.lvl + 1, f.proof || s.l || s.r, sha256(s.l || f.x || s.r)
  from risen f join upper_sides s on s.lvl = f.lvl and s.pos = f.pos where f.total > 1)
select doc_id, leaf, subroot, (select digest from upper_nodes where total = 1) as root, sha256(proof) as proof_sha256, x as folded_root,
  x = (select digest from upper_nodes where total = 1) as verified
from risen where total = 1
"""


@query("op13_bitmap_manifest", MANIFEST_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


REPEATS_SQL = r"""
with d as (
  select row_number() over () as row_id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
words as (select row_id, doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as i from d),
windows as (
  select *, case when i <= n - 49 then md5(string_agg(word, ' ') over (partition by row_id order by i rows between current row and 49 following)) end as digest
  from words where n >= 50),
judged as (select *, digest is not null and min(doc_id) over (partition by digest) < doc_id as repeated from windows),
covered as (select *, bool_or(repeated) over (partition by row_id order by i rows between 49 preceding and current row) as gone from judged),
cut as (select row_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept from covered group by row_id)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) as kept_sha256
from d left join cut using (row_id)
"""


@query("op12_recompression_repeats", REPEATS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
