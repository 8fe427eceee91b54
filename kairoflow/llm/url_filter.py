"""URL rules, and redirect equivalence that carries decisions to a page's aliases.

A page's url gets the decision of the longest rule that fits it. Urls without a rule of their own
take the decision of the component they belong to: redirects (meta refresh) and canonical links
are undirected edges, and an explicit allow anywhere in the component outweighs its blocks.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoflow.llm._components import connected_components

#: (verdict, host, path): the contract's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Up to so many rules are compiled into one expression; more are joined by host suffix.
INLINE_RULES = 256
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?(?:[^\"'>]*\s)?canonical(?=[\s\"'/>]))[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; null or no ``://``: empty."""
    found = F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #``; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What makes two urls one page: host, path and query, without scheme and fragment; null for a
    null url or one without ``://``, which is no page that anything could link."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def _inline(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as (length, verdict, rule); null where none does."""
    cases = []
    for verdict, rule_host, rule_path in rules:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = rule_host + rule_path
        made = F.struct(F.lit(len(name)).alias("length"), F.lit(verdict).alias("verdict"), F.lit(name).alias("rule"))
        cases.append(F.when(fits, made))
    best = F.array_max(F.array_compact(F.array(*cases)))
    return best


def judge_urls(urls: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and ruled (the rule's verdict, else null).

    Equal lengths: the greater (verdict, name) wins, so block before allow. ``rules`` is a list of
    (verdict, host, path) or a DataFrame with those columns. Clashing columns are replaced.
    """
    base = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if not isinstance(rules, DataFrame) and len(rules) <= INLINE_RULES:
        best = _inline(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<length:int,verdict:string,rule:string>")
        base = base.withColumn("_best", best)
        return base.withColumn("rule", F.col("_best.rule")).withColumn("ruled", F.col("_best.verdict")).drop("_best")
    spark = urls.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    table = table.select(F.col("verdict").alias("_v"), F.col("host").alias("_h"), F.col("path").alias("_p"))
    # Distinct (host, path) pairs meet the rules of each suffix of their host.
    pairs = base.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.withColumn("_h", F.explode(suffixes)).join(table, "_h").where(F.col("path").startswith(F.col("_p")))
    name = F.concat("_h", "_p")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("length"), F.col("_v").alias("verdict"), name.alias("rule"))).alias("_best"))
    out = base.drop("rule", "ruled").join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.col("_best.rule")).withColumn("ruled", F.col("_best.verdict")).drop("_best")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): all canonical and meta-refresh targets of pages; targets without a host are relative.
    Pages without a url of their own have no links."""
    source = pages.where(F.lower(html).contains("canonical") | F.lower(html).contains("refresh"))
    targets = F.concat(*[F.regexp_extract_all(F.col(html), F.lit(p), F.lit(1)) for p in (_LINK, _REFRESH)])
    found = source.where(F.contains(F.col(url), F.lit("://"))).select(F.col(url).alias("_url"), F.explode(targets).alias("_to"))
    origin = F.concat(F.lit("x://"), host_of(F.col("_url")))
    folder = F.regexp_extract(path_of(F.col("_url")), r"^(.*/)", 1)
    to = F.col("_to")
    full = (
        F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.startswith("/"), F.concat(origin, to))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), to))
    )
    return found.select(node_of(F.col("_url")).alias("u"), node_of(full).alias("v"))


def filter_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, component_size-free decision source.

    verdict: the rule's; else allow if any alias has an explicit allow, else block if any alias is
    blocked, else allow. ``via`` tells which (rule, alias, default). ``edges`` (u, v as nodes)
    replaces the links found in html. Null urls and urls without ``://`` have empty host and path, are
    no alias of anything and get the default.
    Repeated rows are judged each; an empty table gives no rows; other columns are not read.
    """
    judged = judge_urls(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), rules).withColumn("node", node_of(F.col("url")))
    edges = link_edges(pages, url, html) if edges is None else edges
    parts = connected_components(edges)
    # Explicit decisions of known urls, one row per component; link targets that are no page count by their own rule.
    named = judge_urls(parts.select("component", F.concat(F.lit("x://"), F.col("node")).alias("url")), rules)
    decided = named.where("ruled is not null").groupBy("component").agg(F.max((F.col("ruled") == "allow").cast("int")).alias("allowed"))
    alias = parts.join(decided, "component").select("node", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("inherited"))
    out = judged.join(alias, "node", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", "inherited", F.lit("allow")).alias("verdict"),
        F.when(F.col("ruled").isNotNull(), "rule").when(F.col("inherited").isNotNull(), "alias").otherwise("default").alias("via"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("via")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_SQL_SPLIT = r"^(?s:.)*?://([^/?#]*)([^?#]*)"
ORACLE = {
    "op3_url_filter": f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_SQL_SPLIT}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
  coalesce(regexp_extract(url, '{_SQL_SPLIT}', 2), '') AS path,
  coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*([^#]*)', 1), '') AS rest, html, url AS whole FROM pages),
n AS (SELECT *, CASE WHEN whole LIKE '%://%' THEN host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS node FROM u),
links AS (SELECT node, unnest(regexp_extract_all(html, '(?i)<link[^>]*rel=.canonical.[^>]*href=.([^"'' >]+)', 1) || regexp_extract_all(html, '(?i)<meta[^>]*http-equiv=.refresh.[^>]*url=([^"'' >]+)', 1)) AS to_url FROM n WHERE node IS NOT NULL),
edges AS (SELECT DISTINCT node AS a, translate(regexp_extract(to_url, '{_SQL_SPLIT}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}')
  || CASE WHEN regexp_extract(to_url, '^(?s:.)*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(to_url, '^(?s:.)*?://[^/?#]*([^#]*)', 1) END AS b FROM links WHERE to_url LIKE '%://%'),
sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
hits AS (SELECT n.node, r.verdict, r.h || r.p AS rule FROM (SELECT node, host, path FROM n WHERE node IS NOT NULL UNION SELECT b, split_part(b, '/', 1), regexp_extract(substr(b, strpos(b, '/')), '^([^?#]*)', 1) FROM sides) n, rules r
  WHERE (n.host = r.h OR n.host LIKE '%.' || r.h) AND starts_with(n.path, r.p)),
best AS (SELECT node, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule FROM hits GROUP BY node),
inherited AS (SELECT r.a AS node, CASE WHEN bool_or(b.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM reach r JOIN best b ON b.node = r.b GROUP BY r.a)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, i.verdict, 'allow') AS verdict
FROM n LEFT JOIN best b ON b.node = n.node LEFT JOIN inherited i ON i.node = n.node
"""
}
