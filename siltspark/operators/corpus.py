"""Web-corpus building: canonical URLs, links, cleaning, dedup, crawl snapshots, archives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Path endings that mark an asset.
ASSET_TYPES = (
    "pdf", "doc", "docx", "xlsx", "zip", "tar", "gz", "bz2", "7z", "rar", "exe", "dmg", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "avif", "css", "js", "json", "xml",
    "woff", "woff2", "ttf", "otf", "eot", "mp3", "mp4", "webm", "ogg", "wav", "flac", "avi", "mov", "m4v", "m4a",
)
#: MIME types by path ending.
MIME = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "svg": "image/svg+xml", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "xml": "application/xml", "pdf": "application/pdf", "txt": "text/plain",
}
#: What follows inside a tag.
_IN_TAG = r"""(?=[^<>]*>)"""
#: A quoted or bare attribute value, and one that is a script.
_ANY, _SCRIPT = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", r"""(?:"\s*javascript:[^"]*"|'\s*javascript:[^']*'|javascript:[^\s"'>]*)"""
#: Markup that a cleaned page does without, by the name it is counted under.
REMOVED = {
    "script": r"(?is)<script\b[^>]*>.*?</script\s*>", "noscript": r"(?is)<noscript\b[^>]*>.*?</noscript\s*>", "iframe": r"(?is)<iframe\b[^>]*>.*?</iframe\s*>",
    "object": r"(?is)<object\b[^>]*>.*?</object\s*>", "applet": r"(?is)<applet\b[^>]*>.*?</applet\s*>", "embed": r"(?is)<embed\b[^>]*>", "base": r"(?is)<base\b[^>]*>",
    "refresh": r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh[^>]*>""", "conditional": r"(?is)<!--\s*\[if\b.*?\[endif\]\s*-->",
    "dead_link": r"""(?is)<link\b(?=[^>]*\srel\s*=\s*(?:"[^"]*|'[^']*)?\b(?:preconnect|dns-prefetch|modulepreload)\b)[^>]*>"""
    r"""|<link\b(?=[^>]*\srel\s*=\s*(?:"[^"]*|'[^']*)?\b(?:preload|prefetch)\b)(?=[^>]*\s(?:as\s*=\s*["']?script\b|href\s*=\s*["']?[^"'\s>]*\.js(?=["'\s>])))[^>]*>""",
    "handler": rf"(?is)\son[a-z]+\s*=\s*{_ANY}{_IN_TAG}", "js_url": rf"(?is)\s(?:src|action|formaction|poster|data|background|xlink:href)\s*=\s*{_SCRIPT}{_IN_TAG}",
}

#: The value of an attribute: quoted either way, or bare.
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: How an element's own attributes hide it.
HIDDEN = r"""(?is)\s(?:hidden(?=[\s=>/])|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)(?:display:\s?none|visibility:\s?hidden|opacity:\s?0(?![.\d])))"""


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def clean_path(path: Column) -> Column:
    """Doubled slashes and dot segments folded; a trailing slash stays; empty becomes /."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    folded = F.aggregate(parts, F.array().cast("array<string>"), up)
    tail = F.when(path.rlike(r"(/|/\.|/\.\.)$") & (F.size(folded) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(folded, "/"), tail)


#: Characters of a query that are escaped.
QUERY_ESCAPED = " \t\n\r\\<>\"|?*:"


def escape_query(query: Column) -> Column:
    for c in QUERY_ESCAPED:
        query = F.replace(query, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return query


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment or default port, clean path; null unless http or https."""
    scheme = F.lower(_part(url, 1))
    h = F.when(scheme == "http", F.regexp_replace(host(url), ":80$", "")).otherwise(F.regexp_replace(host(url), ":443$", ""))
    query = F.when(_part(url, 4) == "?", "").when(_part(url, 4) == "", "").otherwise(F.concat(F.lit("?"), escape_query(F.regexp_replace(_part(url, 4), r"^\?", ""))))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), h, clean_path(_part(url, 3)), query))


def page_key(url: Column, seed_host: Column | None = None) -> Column:
    """Directory and leaf of the path; .html where the leaf has no dot, index.html for a directory or index page, else 6 hex digits of the query's SHA-256.

    With seed_host, pages of other hosts begin with theirs.
    """
    path = F.regexp_replace(clean_path(_part(url, 3)), "^/", "")
    query = F.regexp_replace(_part(url, 4), r"^\?", "")
    is_index = (path == "") | path.endswith("/")
    leaf = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    ending = F.when(leaf.contains("."), F.regexp_extract(leaf, r"(\.[^.]*)$", 1)).otherwise(".html")
    mark = F.when(query != "", F.concat(F.lit("__q-"), F.substring(F.sha2(query, 256), 1, 6))).otherwise("")
    index = F.lower(leaf).isin("index.html", "index.htm")
    plain = F.concat(F.when(leaf.contains("."), stem).otherwise(path), mark, ending)
    key = F.when(is_index, F.concat(path, F.lit("index.html"))).when(index, F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.lit("index.html"))).otherwise(plain)
    if seed_host is None:
        return key
    return F.when(host(url) == F.lower(seed_host), key).otherwise(F.concat(host(url), F.lit("/"), key))


def url_ending(url: Column) -> Column:
    return F.lower(F.regexp_extract(_part(url, 3), r"\.([A-Za-z0-9]+)$", 1))


def url_kind(url: Column) -> Column:
    return F.when(url_ending(url).isin(*ASSET_TYPES), "asset").otherwise("page")


def mime_of(url: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[url_ending(url)], F.lit("application/octet-stream"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def clean_pages(pages: DataFrame) -> DataFrame:
    """page_id, html without active markup, how much of each kind was removed, and whether a character set had to be named.

    A link that is a script leads to # then; other attributes that are scripts go.
    """
    html, counts = F.col("html"), []
    for name, pattern in REMOVED.items():
        counts.append(F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias(f"n_{name}"))
        html = F.regexp_replace(html, pattern, "")
    link = rf"(?is)(\s)href\s*=\s*{_SCRIPT}{_IN_TAG}"
    counts.append(F.size(F.regexp_extract_all("html", F.lit(link), F.lit(0))).alias("n_js_link"))
    out = pages.select("page_id", F.regexp_replace(html, link, '$1href="#"').alias("html"), *counts)
    # both in one select would copy the cleaning into each use
    bare, meta = ~F.col("html").rlike(r"(?is)<meta\b[^>]*\bcharset\s*="), '<meta charset="utf-8">'
    headed = F.when(F.col("html").rlike(r"(?i)<head[\s>]"), F.regexp_replace("html", r"(?is)^(.*?<head(?:\s[^>]*)?>)", f"$1{meta}")).otherwise(F.concat(F.lit(meta), "html"))
    return out.withColumn("n_charset", bare.cast("int")).withColumn("html", F.when(bare, headed).otherwise(F.col("html")))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; empty without it."""
    return F.concat(*[F.regexp_extract(tag, rf"(?is)\s{name}{VALUE}", g) for g in (1, 2, 3)])


def resolve_ref(base: Column, ref: Column) -> Column:
    """The canonical absolute URL of a reference on a page; null for fragments, data, mail, scripts and the like."""
    r = F.trim(ref)
    root, path = F.concat(_part(base, 1), F.lit("://"), _part(base, 2)), _part(base, 3)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    full = F.when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r).when(r.startswith("//"), F.concat(_part(base, 1), F.lit(":"), r)).when(r.startswith("/"), F.concat(root, r))
    full = full.when(r.startswith("?"), F.concat(root, path, r)).otherwise(F.concat(root, folder, r))
    return F.when((r != "") & ~r.startswith("#"), canonical_url(full))


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, url, target: the distinct canonical URLs that a page's anchors, areas and iframes lead to.

    Elements that their own attributes hide are left out.  Repeats are removed within a page, without a shuffle.
    """
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<(?:a|area|iframe)\s[^>]*>"), F.lit(0)), lambda t: ~t.rlike(HIDDEN))
    refs = F.array_distinct(F.transform(tags, lambda t: F.when(t.rlike("(?i)^<iframe"), attribute(t, "src")).otherwise(attribute(t, "href"))))
    targets = F.array_distinct(F.array_compact(F.transform(refs, lambda r: resolve_ref(F.col("url"), r))))
    return pages.select("page_id", "url", F.explode(targets).alias("target"))


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the crawled page of the same host and key; page null where dangling."""
    key = lambda u: F.concat(host(u), F.lit("/"), page_key(u))
    known = pages.select(key(F.col("url")).alias("key"), F.col("page_id").alias("to_page")).groupBy("key").agg(F.min("to_page").alias("to_page"))
    return links.withColumn("key", key(F.col("target"))).join(known, "key", "left")


def in_scope(url: Column, seed_host: str, subdomains: bool, prefix: str, excludes: list[str]) -> Column:
    h = host(url)
    same = (h == seed_host) | (h.endswith("." + seed_host) if subdomains else F.lit(False))
    path = _part(url, 3)
    out = F.lower(_part(url, 1)).isin("http", "https") & same & path.startswith(prefix)
    for e in excludes:
        out = out & ~path.startswith(e)
    return out


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """Whether the longest rule whose path starts the URL's allows it, of equal ones one that allows; without a rule, yes.

    A ``*`` in a rule stands for any text, a ``$`` at its end for the path's end.  What stands before them is a rule's key:
    a path's beginnings, of the lengths that keys of its host have, meet the keys in an equi-join.  Where rules have an ``agent``, a host's group for the agent counts, and that for * only if there is none.
    """
    if "agent" in rules.columns:
        own = F.lower("agent") == agent.lower()
        groups = rules.where(own | (F.col("agent") == "*")).withColumn("_own", F.max(own).over(W.partitionBy("host")))
        rules = groups.where(own == F.col("_own"))
    u = urls.select("page_id", F.col("host"), F.col("path"))
    key = F.regexp_extract("rule_path", r"^([^*]*?)(?:\*|\$$|$)", 1)
    plain = F.regexp_replace(F.regexp_replace("rule_path", r"([\\.^|?+()\[\]{}])", r"\\$1"), r"\*", ".*")
    pattern = F.concat(F.lit("(?s)^"), F.regexp_replace(plain, r"\$(?!$)", r"\\\$"))
    r = rules.where("rule_path <> ''").select("host", "rule_path", "allow", key.alias("key"), F.when(F.col("rule_path").rlike(r"\*|\$$"), pattern).alias("pattern")).distinct()
    sizes = r.groupBy("host").agg(F.collect_set(F.length("key")).alias("sizes"))  # a number for each length of key
    begun = u.join(sizes, "host").select("page_id", "host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    hit = begun.withColumn("key", F.left("path", F.col("n"))).join(r, ["host", "key"]).where("pattern is null or regexp_like(path, pattern)")
    best = hit.groupBy("page_id").agg(F.max_by("allow", F.struct(F.length("rule_path"), F.col("allow"))).alias("allow"))
    return u.join(best, "page_id", "left").select("page_id", F.coalesce("allow", F.lit(True)).alias("allowed"))


#: Names of folders and files that are not searched.
UNSEARCHED = (".git", "node_modules", ".venv", "vendor", "__pycache__", "*.pyc", "*.class", "*.o", "*.so", "*.dll", "*.exe", "*.bin", "*.zip", "*.tar*", "*.gz")


def grep(docs: DataFrame, pattern: str, path: str | None = None, excluded: tuple[str, ...] = UNSEARCHED) -> DataFrame:
    """Lines that a pattern is found in, numbered from 1; with path, a column, not of files with an excluded name in their path."""
    if path and excluded:
        name = "^(" + "|".join(re.escape(g).replace(r"\*", ".*") for g in excluded) + ")$"
        docs = docs.where(~F.coalesce(F.exists(F.split(path, "/"), lambda part: part.rlike(name)), F.lit(False)))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def dedup_stats(docs: DataFrame) -> DataFrame:
    """Copies beyond the first of each SHA-256, and their bytes; one hash a row, no text is shuffled."""
    h = docs.select(F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("size")).groupBy("h").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return h.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("size")).alias("bytes_saved"))


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, unchanged, changed or removed for each url, by content hash."""
    o, n = (df.select("url", F.md5("html").alias(k)) for df, k in ((old, "was"), (new, "now")))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return o.join(n, "url", "full").select("url", status.alias("status"))


def resolve_redirects(articles: DataFrame, hops: int = 8) -> DataFrame:
    """Where a chain of ``url, to`` ends after so many hops; reason: ok, missing, or loop for what goes on."""
    out = articles.where("to is not null").select("url", F.col("to").alias("at"))
    step = articles.select(F.col("url").alias("at"), F.col("to").alias("next"), F.lit(True).alias("found"))
    for _ in range(hops):  # one join a hop
        out = out.join(step, "at", "left").select("url", F.coalesce("next", "at").alias("at"))
    last = out.join(step, "at", "left")
    ended = last.select("url", F.col("at").alias("target"), F.when(F.col("found").isNull(), "missing").when(F.col("next").isNull(), "ok").otherwise("loop").alias("reason"))
    return ended.unionByName(articles.where("to is null").select("url", F.col("to").alias("target"), F.lit("ok").alias("reason")))


def fingerprint(pages: DataFrame) -> DataFrame:
    """A digest of row digests that no row order changes, in two levels, so that no task joins all rows."""
    row = F.md5(F.concat_ws("|", "url", F.md5("html")))
    parts = pages.select(row.alias("d")).groupBy(F.substring("d", 1, 3).alias("p")).agg(F.md5(F.array_join(F.sort_array(F.collect_list("d")), "")).alias("d"))
    return parts.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "")).alias("fingerprint"))


#: Response headers of networks that shield a site.
SHIELD_HEADERS = (
    "cf-ray", "cf-chl-bypass", "cf-chl-out", "cf-chl-proxied", "cf-cache-status", "cf-connecting-ip", "cf-ipcountry", "cf-visitor", "x-sucuri-id", "x-sucuri-cache", "x-iinfo", "x-cdn",
)
#: Texts of a challenge page, and of a page that asks for a human, in the order in which they are tried.
CHALLENGE_TEXTS = ("challenges.cloudflare.com", "challenges.cloudflare.com/turnstile", "cf-turnstile", "turnstile", "__cf_chl", "cf_chl_")
CAPTCHA_TEXTS = (
    "captcha", "verify you are human", "verify you are a human", "are you a human", "please verify", "security check", "cf-challenge", "cf_challenge", "cf-browser-verification",
    "checking your browser", "ddos protection", "access denied", "blocked", "your request has been blocked", "please enable javascript", "javascript is required", "browser check",
    "automated access", "suspicious activity",
)


def block_reason(status: Column, html: Column, headers: Column | None = None) -> Column:
    """Why a page is a block page: status codes, headers (a map, names in lower case), then the body; null for a good one."""
    text = F.lower(html)
    shielded = F.coalesce(F.exists(F.map_keys(headers), lambda h: F.lower(h).isin(*SHIELD_HEADERS)), F.lit(False)) if headers is not None else F.lit(False)
    out = F.when(status == 403, "forbidden").when(status == 429, "rate limited").when(shielded, "challenge").when(status == 503, "unavailable").when(F.trim(html) == "", "empty")
    out = out.when((F.length(html) < 200) & (text.contains("forbidden") | text.contains("denied")), "denied")
    holds = lambda marks: F.greatest(*[text.contains(m) for m in marks])
    return out.when(holds(CHALLENGE_TEXTS), "challenge").when(holds(CAPTCHA_TEXTS), "captcha")


def block_snippet(html: Column, around: int = 60) -> Column:
    """What stands around the first listed text that a page holds, blanks folded; empty without one."""
    text, at = F.lower(html), F.when(F.lit(False), F.struct(F.lit(0).alias("p"), F.lit(0).alias("n")))
    for mark in CAPTCHA_TEXTS:
        at = at.when(text.contains(mark), F.struct(F.locate(mark, text).alias("p"), F.lit(len(mark)).alias("n")))
    start = F.greatest(at["p"] - around, F.lit(1))
    cut = F.substring(html, start, F.least(at["p"] + at["n"] + around, F.length(html) + 1) - start)
    return F.when(at.isNotNull(), F.trim(F.regexp_replace(cut, r"\s+", " "))).otherwise("")


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """SHA-256 in hex for dedup, or md5: and the MD5 for caches."""
    return F.sha2(content, 256) if algorithm == "sha256" else F.concat(F.lit("md5:"), F.md5(content))


def unseen(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Candidates whose key hasn't been seen, each key once; null keys go."""
    return candidates.where(F.col(key).isNotNull()).dropDuplicates([key]).join(seen.select(key), key, "left_anti")


#: Where markup and style sheets refer to something else, by kind.
REFERENCES = {
    "attribute": r"""(?is)\s(?:href|src|poster|data)\s*=\s*["']([^"']+)["']""", "srcset": r"""(?is)\ssrcset\s*=\s*["']([^"']+)["']""",
    "css": r"""(?is)url\(\s*["']?([^"')]+)["']?\s*\)""", "import": r"""(?is)@import\s+["']([^"']+)["']""",
}


def all_refs(pages: DataFrame) -> DataFrame:
    """page_id, kind, ref: each distinct reference of a page; a srcset's candidates one by one, without their sizes."""
    named = lambda found, kind: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref")))
    every = []
    for kind, pattern in REFERENCES.items():
        found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
        if kind == "srcset":
            found = F.transform(F.flatten(F.transform(found, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1))
        every.append(named(found, kind))
    return pages.select("page_id", F.inline(F.array_distinct(F.concat(*every)))).where("ref <> ''")


def mime_counter(urls: DataFrame) -> DataFrame:
    """How many URLs have each MIME type."""
    return urls.groupBy(mime_of(F.col("url")).alias("mime")).agg(F.count("*").alias("n"))


def mime_string(counts: DataFrame) -> DataFrame:
    """``counter``: ``mime=n`` of every type in order, joined by semicolons; types are few, however many URLs there are."""
    pairs = F.sort_array(F.collect_list(F.struct("mime", "n")))
    return counts.where("mime is not null").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["mime"], F.lit("="), x["n"].cast("string"))), ";").alias("counter"))


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key with where it is: old, new or both; one shuffle of keys."""
    sides = old.select(key, F.lit(1).alias("side")).union(new.select(key, F.lit(2)))
    where = sides.groupBy(key).agg(F.bit_or("side").alias("side"))
    return where.select(key, F.when(F.col("side") == 3, "both").when(F.col("side") == 1, "old").otherwise("new").alias("side"))


def rel_path(source: Column, target: Column) -> Column:
    """The path from source's directory to target; a source whose last part has a dot is a file in it."""
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    s, t = parts(source), parts(target)
    s = F.when(F.coalesce(F.try_element_at(s, F.lit(-1)).contains("."), F.lit(False)), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
    first = F.nullif(F.array_position(F.zip_with(s, t, lambda a, b: a.eqNullSafe(b)), F.lit(False)), F.lit(0).cast("long"))
    common = F.coalesce(first - 1, F.size(s)).cast("int")
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(s) - common), F.slice(t, common + 1, F.size(t)))
    return F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))


def multiset_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``n, digest`` of a table as a multiset of rows, whatever their order and partitions.

    Two sums over halves of the rows' MD5s, and their number, so no list grows with the table; a null is told from an
    empty text.  It shows chance changes, not ones that someone computes to leave the sums as they are.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    d = F.md5(F.array_join(F.array(*[F.concat(F.char_length(p).cast("string"), p) for p in parts]), ""))
    half = lambda at: F.conv(F.substring(d, at, 15), 16, 10).cast("decimal(20, 0)")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38, 0)")
    sums = rows.select(half(1).alias("a"), half(16).alias("b")).agg(F.count("*").alias("n"), total("a").alias("a"), total("b").alias("b"))
    return sums.select("n", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "a", "b")])).alias("digest"))
