"""URL filters: host and path rules, and block decisions that travel along redirects and canonical links.

A page's own rule decides first, the longest that fits. Pages without a rule are judged by their aliases:
meta-refresh redirects and canonical links are edges between URLs, their connected components are found by the
cluster (see :mod:`millrace.llm.graph`), and a component that holds a blocked URL blocks its
pages. An allow rule is explicit and takes precedence for the page it fits; it doesn't travel. URLs that only
appear as targets are judged by the rules too, so a page that redirects into a blocked site is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, drop, look_up, read, table
from millrace.llm.graph import components

Rule = tuple[str, str, str]
#: The rules of op9: verdict, host, path.
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Of equally long ones the first by text wins.

    Rules are looked up by each suffix of the host, so their number doesn't matter to a row's cost.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r[1].lower(), []).append(r)
    entry = lambda r: F.struct((-F.length(F.lit(r[1] + r[2]))).alias("n"), F.lit(r[1].lower() + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"), F.lit(r[2]).alias("path"))
    known = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*[entry(r) for r in rs]))])
    parts = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    fits = F.flatten(F.transform(names, lambda n: F.filter(F.coalesce(F.element_at(known, n), F.array().cast("array<struct<n:int,rule:string,verdict:string,path:string>>")), lambda e: F.startswith(path, e["path"]))))
    best = F.array_min(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _node(url: Column) -> Column:
    """A URL as a node: without its fragment, scheme and host lower-cased."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(ascii_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def targets(url: Column, html: Column) -> Column:
    """Array of the URLs that a page names as itself: its canonical link and its meta-refresh target, absolute.

    Only http and https targets, or ones relative to the page's host, count; entities ``&amp;`` are decoded.
    """
    decoded = lambda t: F.replace(t, F.lit("&amp;"), F.lit("&"))
    head = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    folder = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*)?/)", 1)
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    links = F.filter(links, lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""))
    links = F.transform(links, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s>"']+)""", 0))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    metas = F.filter(metas, lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""))
    # the refresh target ends where the decoded attribute ends, or at the quote that it opens itself
    metas = F.transform(metas, lambda t: decoded(F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*(?:"[^">]*|'[^'>]*|[^\s"'>]+)""", 0)))
    metas = F.transform(metas, lambda t: F.regexp_replace(t, r"""(?is)^content\s*=\s*["']?""", ""))
    metas = F.transform(metas, lambda t: F.regexp_extract(t, r"""(?is)^[\s\d.]*[;,]?\s*(url\s*=\s*(?:"[^"]*|'[^']*|[^"'].*))""", 1))
    bare = lambda t: F.regexp_replace(t, r"""(?is)^(?:href|url)\s*=\s*["']?\s*|["'\s]+$""", "")

    def absolute(t: Column) -> Column:
        return (
            F.when(t.rlike("(?i)^https?://"), t)
            .when(F.startswith(t, F.lit("//")), F.concat(scheme, t))
            .when(F.startswith(t, F.lit("/")), F.concat(head, t))
            .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (t == "") | F.startswith(t, F.lit("#")), F.lit(None))
            .otherwise(F.concat(F.when(folder == "", F.concat(head, F.lit("/"))).otherwise(folder), t))
        )

    named = F.concat(F.transform(links, lambda t: decoded(bare(t))), F.transform(metas, bare))
    return F.filter(F.transform(named, absolute), lambda t: t.isNotNull())


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule (or null), verdict (allow or block).

    Null URLs and URLs without ``://`` have an empty host and path, fit no rule, have no aliases and are allowed. A null
    html has no links. Rows with null or repeated ids keep their rows; pages with the same URL are one node. Extra
    columns are ignored. An empty table gives an empty result.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = p.where("url LIKE '%://%' AND html IS NOT NULL").select(_node(F.col("url")).alias("a"), F.explode(targets(F.col("url"), F.col("html"))).alias("b"))
    edges = table(found.select("a", _node(F.col("b")).alias("b")).where("a != b"), "aliases")
    comp = components(edges)
    judged = comp.withColumn("r", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    blocked = judged.where("r.verdict = 'block'").select("component").distinct()
    bad = table(look_up(comp, "component", blocked, "node", "inner").select("node").distinct(), "blocked")
    drop(edges, comp)
    own = p.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", F.when(F.col("r").isNull() & F.col("url").contains("://"), _node(F.col("url"))))
    out = own.join(bad.withColumn("hit", F.lit(True)), own["key"] == bad["node"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return out.select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return judge(read(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


OP9_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN position('://' IN url) > 0 THEN
           translate(regexp_extract(substr(url, position('://' IN url) + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS rn
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), edge AS (
  SELECT regexp_replace(url, '#.*$', '') AS a, t AS b
  FROM p, unnest(regexp_extract_all(html, '<link[^>]*rel="canonical"[^>]*href="(https?://[^"#]*)', 1)
              || regexp_extract_all(html, '<meta[^>]*http-equiv="refresh"[^>]*url=(https?://[^"#]*)', 1)) AS u(t)
  WHERE t <> ''
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
judged AS (
  SELECT a, b, translate(regexp_extract(substr(b, position('://' IN b) + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(b, position('://' IN b) + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM reach
), ranked AS (
  SELECT a, b, verdict, row_number() OVER (PARTITION BY a, b ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS rn
  FROM judged JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), bad AS (SELECT DISTINCT a FROM ranked WHERE rn = 1 AND verdict = 'block')
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fit f ON f.page_id = p.page_id AND f.rn = 1 LEFT JOIN bad ON bad.a = regexp_replace(p.url, '#.*$', '')
"""
