"""Assets of web pages: references, local keys, policy; ignore lists and crawl plans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltspark.operators.corpus import VALUE, _part, attribute, clean_path, host, resolve_ref, url_ending

#: Path endings of video, audio, documents, archives and installers, which a crawl leaves where they are.
SKIPPED_TYPES = (
    "mp4", "m4v", "webm", "avi", "mov", "mkv", "wmv", "flv", "m3u8", "ts", "mp3", "wav", "ogg", "flac", "aac", "m4a", "wma", "oga", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "tar", "gz", "bz2", "7z", "rar", "tgz", "xz", "dmg", "iso", "exe", "msi", "apk", "pkg", "deb", "rpm", "appimage",
)
#: Elements and the attribute in which each refers to an asset.
ASSET_ATTRIBUTES = (
    ("img", "src"), ("source", "src"), ("video", "src"), ("video", "poster"), ("audio", "src"), ("track", "src"), ("embed", "src"), ("object", "data"), ("script", "src"),
)
#: Link relations that name an asset.
ASSET_RELATIONS = ("stylesheet", "icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon", "manifest", "preload")


def registrable(h: Column, suffixes: Sequence[str] = ()) -> Column:
    """The last two labels of a host without its port; the last three under a listed two-label suffix."""
    labels = F.split(F.regexp_replace(h, r":\d+$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(n)), F.lit(n)), ".")
    return F.when(last(2).isin(*suffixes), last(3)).otherwise(last(2)) if suffixes else last(2)


def want_asset(url: Column, seed: Column, same_domain: bool = True, skipped: Sequence[str] = SKIPPED_TYPES, suffixes: Sequence[str] = ()) -> Column:
    """Whether to fetch an asset: http or https, of the seed's registrable domain, no skipped type; a null URL is not wanted."""
    out = F.lower(_part(url, 1)).isin("http", "https") & ~url_ending(url).isin(*skipped)
    if same_domain:
        out = out & (registrable(host(url), suffixes) == registrable(host(seed), suffixes))
    return F.coalesce(out, F.lit(False))


def asset_key(url: Column, prefix: str = "_assets") -> Column:
    """prefix/host/directory/name, 6 hex digits of the query's SHA-256 before the ending; index for an empty path."""
    path = F.regexp_replace(clean_path(_part(url, 3)), "^/|/$", "")
    path = F.when(path == "", "index").otherwise(path)
    ending = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    query = F.regexp_replace(_part(url, 4), r"^\?", "")
    mark = F.when(query != "", F.concat(F.lit("__q-"), F.substring(F.sha2(query, 256), 1, 6))).otherwise("")
    return F.concat(F.lit(f"{prefix}/"), host(url), F.lit("/"), F.substring(path, F.lit(1), F.length(path) - F.length(ending)), mark, ending)


def extract_assets(pages: DataFrame) -> DataFrame:
    """page_id, element, url: each distinct asset that a page's elements, srcsets and style rules refer to.

    One pass over a page's text for each kind; no shuffle, for repeats are only removed within a page.
    """
    def found(pattern: str, *groups: int) -> Column:
        every = [F.regexp_extract_all("html", F.lit(pattern), F.lit(g)) for g in groups]
        return F.filter(F.flatten(F.array(*every)), lambda x: x != "")

    named = lambda refs, element: F.transform(refs, lambda x: F.struct(F.lit(element).alias("element"), x.alias("ref")))
    kinds = [named(found(rf"(?is)<{tag}\b[^>]*?\s{name}{VALUE}", 1, 2, 3), f"{tag}.{name}") for tag, name in ASSET_ATTRIBUTES]
    links = F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    links = F.filter(links, lambda t: F.arrays_overlap(F.split(F.lower(F.trim(attribute(t, "rel"))), r"\s+"), F.array(*map(F.lit, ASSET_RELATIONS))))
    kinds.append(named(F.transform(links, lambda t: attribute(t, "href")), "link.href"))
    sets = found(r"""(?is)<(?:img|source)\b[^>]*?\ssrcset\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1, 2)
    kinds.append(named(F.transform(F.flatten(F.transform(sets, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)), "srcset"))
    kinds.append(named(found(r"""(?is)url\(\s*(?:"([^"]*)"|'([^']*)'|([^'")\s]+))\s*\)""", 1, 2, 3), "css.url"))
    kinds.append(named(found(r"""(?is)@import\s+(?:"([^"]*)"|'([^']*)')""", 1, 2), "css.import"))
    whole = lambda x: F.struct(x["element"].alias("element"), resolve_ref(F.col("url"), x["ref"]).alias("url"))
    refs = F.filter(F.transform(F.array_distinct(F.concat(*kinds)), whole), lambda x: x["url"].isNotNull())
    return pages.select("page_id", F.inline(F.array_distinct(refs)))


def _glob(glob: str) -> str:
    """The pattern of a glob whose *, ? and [...] stay within one part of a path."""
    out = []
    for token in re.findall(r"\[\^?[^\]]+\]|\\.|.", glob, re.S):
        if token in ("*", "?"):
            out.append("[^/]*" if token == "*" else "[^/]")
        elif len(token) > 1 and token[0] == "[":
            out.append(token)
        else:
            out.append(re.sub(r"(\W)", r"\\\1", token[-1]))
    return "".join(out)


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether a list of ignore rules leaves a path out: the last rule that fits decides, ! takes it back in.

    Blank lines and # comments are no rules.  A rule is a glob with anything before it, and after it too unless
    it begins with /; it fits the whole path or any part of it.  Rules become one column, without a join.
    """
    out = None
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        negate, rule = rule.startswith("!"), rule.removeprefix("!").removesuffix("/")
        glob = _glob("*" + rule[1:] if rule.startswith("/") else f"*{rule}*")
        # a glob with a slash can only fit the whole path
        fits = path.rlike(f"^{glob}$" if "/" in rule.lstrip("/") else f"(^|/){glob}(/|$)")
        out = (fits, not negate, out)
    decision, chain = F.lit(False), []
    while out:
        fits, verdict, out = out
        chain.append((fits, verdict))
    for fits, verdict in reversed(chain):
        decision = F.when(fits, verdict).otherwise(decision)
    return F.coalesce(decision, F.lit(False))


def crawl_plan(frontier: DataFrame, mode: str = "bfs", max_pages: int = 0, max_depth: int = 0) -> DataFrame:
    """``key, depth`` in crawl order: each key at its least depth, shallow first for bfs and deep first for dfs.

    Rows deeper than max_depth go first, then all beyond max_pages; 0 means no limit.
    """
    if max_depth:
        frontier = frontier.where(F.col("depth") <= max_depth)
    plan = frontier.groupBy("key").agg(F.min("depth").alias("depth")).orderBy(F.desc("depth") if mode == "dfs" else F.asc("depth"), "key")
    return plan.limit(max_pages) if max_pages else plan
