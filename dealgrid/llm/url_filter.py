"""URL verdicts by host and path rules, with blocks carried to redirect and canonical-link aliases."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.llm.common import connected_components

#: Query parameters that name a visit, not a page.
TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"

#: A tag that may hold a link or its base, up to the first > outside quotes, or the first one if a quote stays open; comments are left out.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:base|link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*>|<(?:base|link|meta)\b[^>]*>""", re.I | re.S)
_REFRESH = re.compile(r"""\A[\s\d.]*[;,\s]\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name under which aliases of a page meet: host, path and the query without visit parameters, no scheme or fragment."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    page = F.concat(F.regexp_replace(host_of(url), r":(80|443)$", ""), F.when(path_of(url) == "", "/").otherwise(path_of(url)))
    page = F.concat(page, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.locate("://", url) > 0, page)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule, as a struct (rule, verdict); null if none fits.

    `rules` holds (verdict, "host/path") pairs: a short list of the caller, written into the plan. A rule fits its host
    and all subdomains of it, if the path starts with the rule's path.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class _Links(HTMLParser):
    """The first base href and the targets of all canonical links and refresh redirects among some tags, entities decoded."""

    def __init__(self):
        super().__init__()
        self.base: str | None = None
        self.targets: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # The first of several attributes of a name counts.
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and "href" in own and self.base is None:
            self.base = own["href"].strip()
        elif tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.targets.append(own.get("href", "").strip())
        elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            found = _REFRESH.match(own.get("content", ""))
            self.targets.append(next((g for g in found.groups() if g is not None), "").strip() if found else "")


def link_targets(url: str, html: str) -> list[str]:
    """Absolute targets of a page's canonical links and refresh redirects, by RFC 3986 from its base href or its url."""
    links = _Links()
    for tag in _TAG.findall(html):
        if not tag.startswith("<!--"):
            # Each tag on its own: what stands before it can't hide it.
            links.feed(tag)
            links.reset()
    out = []
    for target in filter(None, links.targets):
        try:
            out.append(urljoin(urljoin(url, links.base or ""), target))
        except ValueError:
            # No address, such as a bracket left open in the host.
            continue
    return out


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) node pairs from all canonical links and refresh redirects in the pages' html."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, t) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()) for t in link_targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], ["url", "to"])

    with_links = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)<(link|meta)\b")).select("url", "html")
    targets = with_links.mapInArrow(links, "url string, to string")
    targets = targets.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"))
    return targets.where("a is not null and b is not null and a <> b")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], redirects: DataFrame | None = None, default: str = "allow"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, node, component.

    A page with a fitting rule gets the longest rule's verdict, so an explicit allow is never overruled. Any other page is
    blocked if a page or link target of its alias class is blocked by a rule, else it gets `default`. Alias classes are the connected components of
    canonical links, refresh redirects and `redirects` (from_url, to_url), between nodes that leave out scheme, fragment and
    visit parameters. Null urls, urls without :// and pages with null html have no aliases; repeated pages are judged each.
    """
    urls = pages.select("page_id", "url")
    own = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    own = own.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    edges = alias_edges(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        edges = edges.unionByName(more.where("a is not null and b is not null and a <> b"))
    classes = connected_components(edges, "alias-classes").withColumnRenamed("node", "_node")
    # Blocks of the pages and of link targets that are no page themselves.
    site = F.regexp_extract("_node", "^[^/?]*", 0)
    target = rule_of(site, F.regexp_extract("_node", r"^[^/?]*([^?]*)", 1), rules)
    blocked = own.where("_r.verdict = 'block' and node is not null").select("node").unionAll(
        classes.where(target["verdict"] == "block").select(F.col("_node").alias("node"))
    ).distinct()
    to_class = lambda df: df.join(classes, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node")).drop("_node")
    hit = to_class(blocked).select(F.col("component").alias("_hit")).distinct()
    judged = to_class(own).join(hit, F.col("component") == F.col("_hit"), "left")
    method = F.when(F.col("_hit").isNotNull(), "block").otherwise(default)
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", method).alias("verdict"), "node", "component")
