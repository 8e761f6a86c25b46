"""URL filters with redirect equivalence.

A page's own rule decides first: of the rules that fit, the longest. Redirects
(`<meta http-equiv="refresh">`, or a table of them) and canonical links make
edges between urls; their connected components, found with distributed label
propagation, are aliases of one page. A url that no rule fits takes its
component's decision: allow if any alias is explicitly allowed, else block if
any alias is blocked, else allow. An explicit rule of its own is never
overruled.

Only urls that touch an edge enter the components, and only their decisions,
a row for each such url, are joined back to the pages.

Defined results: a null url, or one without `://`, has an empty host and path
and no rule, and is allowed; repeated page_ids give a row each; a hostless
rule never fits.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STR, cut, schema, small_batches
from .components import connected_components

#: (action, "host/path-prefix")
Rule = tuple[str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: F.Column) -> F.Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: F.Column) -> F.Column:
    h = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(h, UPPER, LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: F.Column) -> F.Column:
    """The url as a node: no scheme, no fragment, host in lower case."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(after_scheme(url).isNotNull(), F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def longest_rule(host: F.Column, path: F.Column, rules: Sequence[Rule]) -> F.Column:
    """A struct (action, rule) of the longest rule that fits, or null. Ties
    in length can't both fit unless equal; then block comes first."""
    fit = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        h, slash, p = rule.partition("/")
        if not h:
            continue
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fit = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(fit)
    return fit


_TAG = re.compile(r"<(?:link|meta)\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def targets(url: str, page: str) -> list[str]:
    """The urls that a page's canonical links and refreshes lead to."""
    found = []
    for tag in _TAG.findall(page):
        a = {k.lower(): html.unescape(x or y or z).strip() for k, x, y, z in _ATTRIBUTE.findall(tag)}
        if tag[1:5].lower() == "link" and "canonical" in a.get("rel", "").lower().split():
            to = a.get("href", "")
        elif tag[1:5].lower() == "meta" and a.get("http-equiv", "").lower() == "refresh":
            to = a.get("content", "").partition("=")[2].strip(" '\"")
        else:
            continue
        try:
            to = to and urljoin(url, to)
        except ValueError:
            continue  # no url
        if "://" in to:
            found.append(to)
    return found


def link_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (src, dst) that the pages' own markup states. Python sees only
    pages that hold one of the two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(u, t) for u, h in zip(*(c.to_pylist() for c in b.columns), strict=True) for t in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["src", "dst"])

    small_batches(pages.sparkSession)
    marked = F.col(url_col).contains("://") & F.col(html_col).rlike("(?i)canonical|http-equiv")
    return pages.where(marked).select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema(src=STR, dst=STR))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], *, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: its id, host, path, rule, verdict, and `decided_by`
    (rule, alias or default). `redirects`: more edges, urls (src, dst)."""
    spark = pages.sparkSession
    edges = link_edges(pages, url_col=url_col, html_col=html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    # written before they are filtered: a filter over these long expressions would repeat them
    edges = cut(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")), "url-edges")
    edges = edges.where("src is not null and dst is not null and src <> dst").distinct()

    url = F.col(url_col)
    judged = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    own = F.col("fit.action")
    if edges.isEmpty():
        out = judged.withColumn("alias_action", F.lit(None).cast("string"))
    else:
        parts = connected_components(edges)
        at = F.concat(F.lit("x://"), F.col("node"))
        fit = longest_rule(host_of(at), path_of(at), rules)
        # urls of a component are counted with partial sums, so a third of all urls in one is no group to collect
        said = parts.select("component", fit["action"].alias("action")).groupBy("component").agg(F.bool_or(F.col("action") == "allow").alias("allow"), F.bool_or(F.col("action") == "block").alias("block"))
        action = F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("alias_action")
        aliases = parts.join(said, "component").select("node", action)
        out = judged.join(aliases, "node", "left")
    verdict = F.coalesce(own, F.col("alias_action"), F.lit("allow"))
    by = F.when(own.isNotNull(), "rule").when(F.col("alias_action").isNotNull(), "alias").otherwise("default")
    return out.select(F.col(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), by.alias("decided_by"))
