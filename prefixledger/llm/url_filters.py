"""URL filters: longest host-and-path rule, then redirect equivalence for urls that no rule fits.

Aliases are connected components over redirect and canonical links. A component with a blocked
url blocks all its urls, but an explicit rule of a url itself, allow or block, always comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixledger.llm.common import cut_lineage, packed
from prefixledger.llm.components import components

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    return _lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _match(host_of: Column, path_of: Column, rules) -> tuple[Column, Column]:
    """Rule text and verdict of the longest fitting rule: longest host, then longest path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host_of == rule_host) | host_of.endswith("." + rule_host)) & path_of.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in any quotes or none, entities of ``& / :`` resolved; empty where absent."""
    quoted = rf"(?is)(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, quoted, k) for k in (1, 2, 3)])
    for entity, char in (("&sol;|&#0*47;|&#x0*2f;", "/"), ("&colon;|&#0*58;|&#x0*3a;", ":"), ("&amp;|&#0*38;|&#x0*26;", "&")):
        value = F.regexp_replace(value, f"(?i){entity}", char)
    return F.trim(F.regexp_replace(value, r"[\t\r\n]", ""))


def _without_dots(rest: Column) -> Column:
    """``host/path?query`` with the segments ``.`` and ``..`` of its path resolved."""
    segments = F.split(F.regexp_extract(rest, r"^[^/?#]*/?([^?#]*)", 1), "/")
    resolved = F.transform(F.array(segments), lambda s: F.aggregate(s, F.array().cast("array<string>"), lambda k, x: F.when(x == ".", k).when(x == "..", F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0)))).otherwise(F.concat(k, F.array(x))), lambda k: F.when(F.element_at(s, -1).isin(".", ".."), F.concat(k, F.array(F.lit("")))).otherwise(k)))
    return F.concat(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("/"), F.array_join(F.get(resolved, F.lit(0)), "/"), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1))


def _with_resolved(df: DataFrame, target: str, base: str) -> DataFrame:
    """``df`` with column ``target`` made an absolute url, read from the url ``base``; empty where it names none or the page itself.

    In steps of plain columns, as each of them is used many times.
    """
    value, rest = F.col(target), F.col("_rest")
    others = [c for c in df.columns if c != target]
    df = df.select("*", F.substring_index(base, "://", 1).alias("_scheme"), _after_scheme(F.col(base)).alias("_rest"))
    df = df.select(*others, target, "_scheme", F.regexp_extract(rest, r"^[^/?#]*", 0).alias("_host"), F.regexp_extract(rest, r"^[^?#]*", 0).alias("_page"))
    folder = F.when(F.col("_page").contains("/"), F.regexp_extract("_page", r"^(.*/)[^/]*$", 1)).otherwise(F.concat("_page", F.lit("/")))
    below = (
        F.when(value.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (value == "") | value.startswith("#") | (F.col("_host") == ""), F.lit(None).cast("string"))
        .when(value.startswith("//"), F.substring(value, 3, 1 << 30))
        .when(value.startswith("/"), F.concat("_host", value))
        .when(value.startswith("?"), F.concat("_page", value))
        .otherwise(F.concat(folder, value))
    )
    df = df.select(*others, target, "_scheme", below.alias("_below"))
    below = F.when(F.col("_below").rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), _without_dots(F.col("_below"))).otherwise(F.col("_below"))
    df = df.select(*others, target, "_scheme", below.alias("_below"))
    whole = F.when(value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), value).otherwise(F.coalesce(F.concat("_scheme", F.lit("://"), "_below"), F.lit("")))
    return df.select(*others, whole.alias(target))


def html_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst``: canonical links and refresh redirects in whole pages, as absolute urls.

    Attributes may stand in any order and quotes; relative targets are read from the page's url or its ``<base>``,
    a refresh may omit ``url=``. Null urls or pages give none.
    """
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    found = pages.filter(F.col(url).isNotNull() & F.col(html).rlike(r"(?i)\b(canonical|refresh)\b"))
    first_base = F.regexp_extract(F.col(html), r"(?is)<base\b[^>]*\bhref\b[^>]*>", 0)
    found = found.select(F.col(url).alias("src"), first_base.alias("base"), F.explode(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(0))).alias("tag"))
    found = found.select("src", "tag", _attribute(F.col("base"), "href").alias("base"), _attribute(F.col("tag"), "content").alias("content"), _attribute(F.col("tag"), "href").alias("href"))
    after = r"(?i)^[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:'([^']*)|\"([^\"]*)|([^'\"].*))"
    refresh = F.trim(F.concat(*[F.regexp_extract("content", after, k) for k in (1, 2, 3)]))
    # broken markup, as an unquoted content with a gap, still gives its absolute url
    bare = F.regexp_extract("tag", r"(?i)(?:href\s*=\s*[\"']?|url\s*=\s*[\"']?)\s*([a-z][a-z0-9+.-]*://[^\"'\s>]+)", 1)
    found = found.select("src", "base", bare.alias("bare"), F.when(F.col("tag").rlike("(?i)^<meta"), refresh).otherwise(F.col("href")).alias("dst"))
    found = _with_resolved(found.select("src", "base", F.when(F.col("dst") == "", F.col("bare")).otherwise(F.col("dst")).alias("dst")), "base", "src")
    found = found.select("src", "dst", F.when(F.col("base") == "", F.col("src")).otherwise(F.col("base")).alias("base"))
    # a filter on a column would be moved below and repeat all steps; one within an array is not
    return _with_resolved(found, "dst", "base").select("src", F.explode(F.filter(F.array("dst"), lambda x: x != "")).alias("dst"))


def _node(url: Column) -> Column:
    """Urls that differ in scheme, case of the host or fragment name one resource."""
    return F.concat(host(url), F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1))


def judge(pages: DataFrame, links: DataFrame, *, url: str = "url", rules=RULES) -> DataFrame:
    """``row, host, path, rule, verdict`` for every row of ``pages``.

    ``links`` (``src, dst``) holds redirects and canonical links; an end need not be a page. A url
    without a rule is blocked if its component holds a url that a rule blocks, else allowed. Null or
    malformed urls have empty host and path, no rule and verdict allow. Repeated rows are judged
    alike; empty tables give an empty result. Roots are joined by node, and only nodes of blocked
    components are kept, so pages without links meet no aggregation.
    """
    ends = links.filter("src is not null and dst is not null")
    nodes = ends.select(_node(F.col("src")).alias("u"), _node(F.col("dst")).alias("v"))
    linked = cut_lineage(nodes.filter("u <> v and u <> '' and v <> ''").distinct())
    members = components(linked)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    _, decision = _match(host(as_url), path(as_url), rules)
    # a node's rule depends on host and path alone, both part of the node
    blocked_roots = members.filter(decision == "block").select("root").distinct()
    blocked = cut_lineage(members.join(blocked_roots, "root", "left_semi").select(F.col("node").alias("_blocked")).distinct())
    rows = packed(pages, _url=url)
    rows = rows.select("row", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), _node(F.col("_url")).alias("_node"))
    name, verdict = _match(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("_own"))
    if blocked.isEmpty():
        return rows.select("row", "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict"))
    open_rows = rows.filter("_own is null").join(blocked, F.col("_node") == F.col("_blocked"), "left")
    decided = open_rows.select("row", "host", "path", "rule", F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return rows.filter("_own is not null").select("row", "host", "path", "rule", F.col("_own").alias("verdict")).unionByName(decided)


def _sql_parts() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ranked = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ranked) + " END"
    own = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{d}'" for h, p, d in ranked) + " END"
    return f"{rule} AS rule, {own} AS own"


#: DuckDB statement: the same rules, components by recursion from each blocked node.
ORACLE = rf"""
WITH RECURSIVE parts AS (SELECT page_id, url, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM parts),
judged AS (SELECT page_id, url, html, host, path, host || tail AS node, {_sql_parts()} FROM cut),
tags AS (SELECT node AS u, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS tag FROM judged WHERE url IS NOT NULL),
targets AS (SELECT u, regexp_extract(tag, '(?i)(?:href\s*=\s*["'']?|url\s*=\s*["'']?)\s*([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1) AS dst FROM tags),
ends AS (SELECT u, substr(dst, strpos(dst, '://') + 3) AS rest FROM targets WHERE dst <> ''),
links AS (SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS v FROM ends),
edges AS (SELECT u, v FROM links WHERE u <> '' AND v <> '' UNION SELECT v, u FROM links WHERE u <> '' AND v <> ''),
hosts AS (SELECT u AS node, regexp_extract(u, '^[^/?#]*') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT u FROM edges)),
reach AS (SELECT node FROM (SELECT node, {_sql_parts()} FROM hosts) WHERE own = 'block' UNION SELECT b.v FROM reach r JOIN edges b ON r.node = b.u)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
