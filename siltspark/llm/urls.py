"""URL filters with redirect equivalence.

Host and path rules judge a URL directly, the longest that fits winning.  URLs that redirect to one
another, or name one another as canonical, are aliases: connected components over these edges carry
a block to every member without a rule of its own, unless a member is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.llm.common import saved, table, work_dir
from siltspark.llm.components import components
from siltspark.operators.corpus import clean_path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query, as (action, host, path).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["'\s>][^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["'\s>][^>]*>"""


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Then up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as a struct (n, rule, action); null if none fits.  Ties: the text that sorts last."""
    every = F.array(
        *[
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(action).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path"))
            for action, h, p in rules
        ]
    )
    under = lambda r: (host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))
    return F.array_max(F.filter(every, lambda r: under(r) & path.startswith(r["path"])))


def absolute_url(target: Column, url: Column) -> Column:
    """A link target on a page as an absolute URL; null for an empty one, a fragment, mail, a script and the like."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme, path = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.when(url_path(url) == "", "/").otherwise(url_path(url))
    root, own = F.concat(scheme, F.lit("://"), url_host(url)), F.regexp_extract(t, r"(?s)^([^?#]*)", 1)
    beside = F.concat(root, clean_path(F.concat(F.regexp_replace(path, r"[^/]*$", ""), own)), F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1))
    out = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when((t == "") | t.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
    return out.when(t.startswith("/"), F.concat(root, t)).when(t.startswith("?"), F.concat(root, path, t)).otherwise(beside)


def url_key(url: Column) -> Column:
    """What aliases of one URL share as text: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(url_host(url), F.when(url_path(url) == "", "/").otherwise(url_path(url)), query))


def alias_edges(pages: DataFrame, folder: str) -> DataFrame:
    """``a, b``: URL keys that a canonical link or a meta refresh in ``html`` makes equivalent.

    The link targets are written to folder; else their expressions would be copied into every later filter.
    """
    has = F.col("html").rlike("(?i)canonical|refresh")
    tags = F.concat(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)))
    tag = pages.where(has & F.col("url").contains("://")).select("url", F.explode(tags).alias("tag"))
    target = F.coalesce(
        F.nullif(F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1), F.lit("")),
        F.nullif(F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1), F.lit("")),
    )
    links = saved(tag.select("url", target.alias("target")).distinct(), folder, "targets")
    links = links.select("url", absolute_url(F.col("target"), F.col("url")).alias("to")).distinct()
    return links.select(url_key(F.col("url")).alias("a"), url_key(F.col("to")).alias("b")).where("b is not null and a <> b").distinct()


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """pages (``page_id, url, html``) with ``host, path, rule, verdict``.

    redirects: further edges, as URLs ``source, target``.  A page without a rule is blocked if its
    component has a blocked member, page or mere target, and no allowed one; else allowed.  A null
    url, or one without ://, has an empty host and path and no aliases.  Columns of pages with the names of
    the four new ones are replaced.  Repeated rows are judged alike.
    """
    folder = work_dir(pages.sparkSession)
    edges = alias_edges(pages, folder)
    if redirects is not None:
        edges = edges.union(redirects.select(url_key(F.col("source")), url_key(F.col("target")))).where("a is not null and b is not null and a <> b").distinct()
    edges = saved(edges.select("a", "b", F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")), folder, "edges")
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    judged = judged.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_r.rule"), "_own": F.col("_r.action")}).drop("_r")
    if edges.isEmpty():
        return judged.withColumn("verdict", F.coalesce("_own", F.lit("allow"))).drop("_own")
    labels = components(edges.select("u", "v"), folder)
    keys = edges.select(F.col("a").alias("key"), F.col("u").alias("node")).union(edges.select("b", "v")).distinct()
    host, path = F.regexp_extract("key", r"(?s)^([^/?]*)", 1), F.regexp_extract("key", r"(?s)^[^/?]*([^?]*)", 1)
    action = rule_of(host, path, rules)["action"]
    member = keys.select("node", action.alias("action")).join(labels, "node")
    group = member.groupBy("component").agg((F.bool_or(F.col("action").eqNullSafe("block")) & ~F.bool_or(F.col("action").eqNullSafe("allow"))).alias("_blocked"))
    alias = labels.join(group.where("_blocked"), "component").select(F.col("node").alias("_node"), "_blocked")
    judged = judged.withColumn("_node", F.xxhash64(url_key(F.col("url"))))
    judged = judged.join(alias, "_node", "left").withColumn("verdict", F.coalesce("_own", F.when(F.col("_blocked"), "block"), F.lit("allow")))
    return judged.drop("_node", "_blocked", "_own")


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rules on every page."""
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
OP10_SQL = rf"""
WITH RECURSIVE rules(action, h, p) AS (VALUES {_RULE_ROWS}),
pg AS (SELECT row_number() OVER () AS r, page_id, url, html,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  coalesce(regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1), '') AS query FROM pages),
k AS (SELECT *, CASE WHEN url LIKE '%://%' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS key FROM pg),
tags AS (SELECT key, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, unnest(regexp_extract_all(html, '(?is)<(?:link\b[^>]*\brel\s*=\s*["'']?canonical|meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh)["''\s>][^>]*>')) AS tag FROM k WHERE key IS NOT NULL),
t AS (SELECT key, host, path, coalesce(nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), ''), nullif(regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1), '')) AS u FROM tags),
tu AS (SELECT key, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u WHEN u IS NULL OR regexp_matches(u, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL WHEN u LIKE '//%' THEN 'http:' || u
  WHEN u LIKE '/%' THEN 'http://' || host || u WHEN u LIKE '?%' THEN 'http://' || host || path || u ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || u END AS u FROM t),
e AS (SELECT key AS a, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')
  || CASE WHEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END
  || coalesce(regexp_extract(u, '(?s)^[^?#]*(\?[^#]*)', 1), '') AS b FROM tu WHERE u IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a, a AS b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
acts AS (SELECT n.b, arg_max(action, length(h) + length(p)) AS action FROM (SELECT DISTINCT b FROM s) n
  JOIN rules ON (regexp_extract(n.b, '^([^/?]*)', 1) = h OR ends_with(regexp_extract(n.b, '^([^/?]*)', 1), '.' || h)) AND starts_with(regexp_extract(n.b, '^[^/?]*([^?]*)', 1), p) GROUP BY n.b),
grp AS (SELECT reach.a AS key, bool_or(coalesce(action = 'block', false)) AND NOT bool_or(coalesce(action = 'allow', false)) AS blocked FROM reach LEFT JOIN acts USING (b) GROUP BY reach.a),
own AS (SELECT r, arg_max(action, length(h) + length(p)) AS action, arg_max(h || p, length(h) + length(p)) AS rule FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, own.rule AS rule, coalesce(own.action, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM k LEFT JOIN own USING (r) LEFT JOIN grp USING (key)
"""
