"""Registered queries of the assets, bundles, facts, metrics and whole jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltspark.functions import plugins
from siltspark.operators import assets, bundles, facts
from siltspark.operators import catalog as cat
from siltspark.operators import corpus as web
from siltspark.operators import sessions as ses
from siltspark.plans import jobs
from siltspark.plans.registry import _SCORE_SQL, _TRIPLES_SQL, ORACLES, C, M, T, _catalog, _docs, _messages, _pages, _traces, _triples, query
from siltspark.sources import tables as src

_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _with_assets(s, d):
    """Pages with markup added that names assets by the page's id."""
    n = F.col("page_id").cast("string")
    add = F.concat(
        F.lit("<img alt='x' src=\"/i/"), n, F.lit(".png\" srcset=\"/i/2.png 2x, /i/"), n, F.lit(".png 1x\"><video src='//cdn.example.org/"), n, F.lit(".mp4'></video><link href=/s.css rel=StyleSheet><style>p{background:url(\"/b/"),
        n, F.lit(".gif\")}</style><script async src=data:x></script><a href='/no.png'>"),
    )
    return _pages(s, d).withColumn("html", F.concat("html", add))


_ASSETS_SQL = f"""assets AS (SELECT page_id, unnest([{{'element': 'img.src', 'url': {_ROOT} || '/i/' || page_id || '.png'}}, {{'element': 'srcset', 'url': {_ROOT} || '/i/2.png'}}, {{'element': 'srcset', 'url': {_ROOT} || '/i/' || page_id || '.png'}},
{{'element': 'video.src', 'url': regexp_extract(url, '^([a-z]+)', 1) || '://cdn.example.org/' || page_id || '.mp4'}}, {{'element': 'link.href', 'url': {_ROOT} || '/s.css'}}, {{'element': 'css.url', 'url': {_ROOT} || '/b/' || page_id || '.gif'}}]) AS a, url AS page FROM pages)"""


@query(f"WITH {_ASSETS_SQL} SELECT DISTINCT page_id, a.element AS element, lower(regexp_extract(a.url, '^([a-z]+://[^/]*)', 1)) || regexp_extract(a.url, '^[a-z]+://[^/]*(.*)', 1) AS url FROM assets")
def extract_assets(s, d):
    return assets.extract_assets(_with_assets(s, d))


@query(f"""WITH {_ASSETS_SQL} SELECT DISTINCT page_id, a.url AS url FROM assets WHERE NOT ends_with(a.url, '.mp4')
AND array_to_string(string_split(regexp_extract(a.url, '^[a-z]+://([^/]*)', 1), '.')[-2:], '.') = array_to_string(string_split(regexp_extract(page, '^[a-z]+://([^/?#]*)', 1), '.')[-2:], '.')""")
def want_asset(s, d):
    pages = _pages(s, d).select("page_id", F.col("url").alias("page"))
    return assets.extract_assets(_with_assets(s, d)).join(pages, "page_id").where(assets.want_asset(F.col("url"), F.col("page"))).select("page_id", "url").distinct()


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS h, regexp_replace({_PATH}, '^/|/$', '', 'g') AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
e AS (SELECT *, CASE WHEN p = '' THEN 'index' ELSE p END AS f, regexp_extract(p, '(\\.[^./]*)$', 1) AS e FROM p)
SELECT page_id, '_assets/' || h || '/' || substr(f, 1, length(f) - length(e)) || CASE WHEN q <> '' THEN '__q-' || substr(sha256(q), 1, 6) ELSE '' END || e AS key FROM e""")
def asset_key(s, d):
    return _pages(s, d).select("page_id", assets.asset_key(F.col("url")).alias("key"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches({_PATH}, '(^|/)[^/]*keep[^/]*(/|$)') THEN false WHEN regexp_matches({_PATH}, '(^|/)[^/]*1[0-4][^/]*(/|$)') THEN true
WHEN regexp_matches({_PATH}, '(^|/)[^/]*15[^/]*(/|$)') THEN false WHEN regexp_matches({_PATH}, '(^|/)[^/]*en[^/]*(/|$)') THEN true ELSE false END AS ignored FROM pages""")
def ignored(s, d):
    return _pages(s, d).select("page_id", assets.ignored(web._part(F.col("url"), 3), ["# rules", "en/", "!15", "", "1[0-4]", "!*keep*"]).alias("ignored"))


@query(f"""WITH f AS (SELECT {_HOST} || {_PATH} AS key, min(len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))) AS depth FROM pages GROUP BY 1)
SELECT key, depth FROM f WHERE depth <= 2 ORDER BY depth DESC, key LIMIT 50""")
def crawl_plan(s, d):
    path = web._part(F.col("url"), 3)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("long")
    return assets.crawl_plan(_pages(s, d).select(F.concat(web.host(F.col("url")), path).alias("key"), depth.alias("depth")), "dfs", 50, 2)


@query("SELECT doc_id, sha256(text) AS sha, 'md5:' || md5(text) AS md5 FROM documents")
def content_hash(s, d):
    return _docs(s, d).select("doc_id", web.content_hash(F.col("text")).alias("sha"), web.content_hash(F.col("text"), "md5").alias("md5"))


@query("SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def unseen(s, d):
    return web.unseen(_pages(s, d).select("url"), _pages(s, d).where("page_id % 3 = 0"), "url")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3")
def recent(s, d):
    return ses.recent(src.load(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SELECT s_suppkey, ['did', NULL, 'spiffe', 'dns', 'x509', 'pgp', NULL][s_suppkey % 7 + 1] AS kind FROM supplier")
def identity_type(s, d):
    forms = F.array(*map(F.lit, ("did:web:", "did", "spiffe://", "dns:", "x509:", "pgp:", "spiffe:")))
    return src.load(s, d, "supplier").select("s_suppkey", cat.identity_type(F.concat(F.element_at(forms, (F.col("s_suppkey") % 7 + 1).cast("int")), F.lower("s_name"))).alias("kind"))


# facts, replies and arguments

_TOLD = """CASE turn % 5 WHEN 0 THEN 'I PREFER it, let''s say: ' WHEN 1 THEN '我们就这样 ' WHEN 2 THEN 'By the way, ' WHEN 3 THEN 'what do you prefer ' ELSE '' END"""
_FACTS_SQL = f"""told AS (SELECT session_id, user_id, turn, {_TOLD} || content AS content FROM messages WHERE role = 'user'),
facts AS (SELECT session_id, user_id, turn, content, CASE """ + " ".join(
    f"WHEN regexp_matches(lower(content), '{'|'.join(w.replace(chr(39), chr(39) * 2) for w in marks)}') THEN '{kind}'" for kind, marks in facts.FACT_MARKS
) + f" END AS kind FROM told WHERE length(trim(content)) >= 20 AND NOT ({' OR '.join(f'starts_with(lower(trim(content)), {chr(39)}{p}{chr(39)})' for p in ses.TRANSIENT)}))"


def _told(s, d):
    t = F.col("turn") % 5
    told = F.when(t == 0, "I PREFER it, let's say: ").when(t == 1, "我们就这样 ").when(t == 2, "By the way, ").when(t == 3, "what do you prefer ").otherwise("")
    return _messages(s, d).withColumn("content", F.when(F.col("role") == "user", F.concat(told, "content")).otherwise(F.col("content")))


@query(f"WITH {M}, {_FACTS_SQL} SELECT session_id, turn, kind FROM facts WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, lower(trim(content)) ORDER BY turn) = 1")
def promote_facts(s, d):
    return facts.promote_facts(_told(s, d)).select("session_id", "turn", "kind")


def _responses(s, d):
    """Replies made of events: fenced, bare, unfenced with words around them, without an issue, or no JSON."""
    e = src.load(s, d, "events")
    body = F.concat(F.lit('{"has_issue": '), F.when(F.col("event_id") % 7 == 0, "false").otherwise("true"), F.lit(', "reason": "r", "patch": "'), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("fix "), F.col("event_type"))), F.lit('", "confidence": '), (F.col("event_id") % 15 / 10).cast("string"), F.lit("}"))
    kind, tick = F.col("event_id") % 4, "`" * 3
    text = F.when(kind == 0, F.concat(F.lit(f"so: {tick}json\n"), body, F.lit(f"\n{tick} and {{ }}"))).when(kind == 1, F.concat(F.lit(f"{tick}\n"), body, F.lit(f"\n{tick}"))).when(kind == 2, F.concat(F.lit("it is "), body, F.lit("."))).otherwise("no answer")
    return e.select("event_id", text.alias("response"))


_PATCHES_SQL = "patches AS (SELECT event_id, 'fix ' || event_type AS patch, least(1.0, event_id % 15 / 10.0)::DOUBLE AS confidence FROM events WHERE event_id % 4 <> 3 AND event_id % 7 <> 0 AND event_id % 11 <> 0)"


@query(f"""WITH {_PATCHES_SQL} SELECT event_id, patch, confidence, NULL AS reject FROM patches UNION ALL
SELECT event_id, NULL, NULL, CASE WHEN event_id % 4 = 3 THEN 'no json' ELSE 'empty patch' END FROM events WHERE event_id % 4 = 3 OR (event_id % 7 <> 0 AND event_id % 11 = 0)""")
def extract_json(s, d):
    good, rejects = facts.parse_patches(_responses(s, d))
    return good.select("event_id", "patch", "confidence").unionByName(rejects.select("event_id", "reject"), allowMissingColumns=True)


@query("""WITH a AS (SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN NULL ELSE k::VARCHAR END AS k, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'fast' ELSE 'slow' END AS mode,
CASE WHEN event_id % 5 = 0 THEN 'missing k' WHEN event_id % 3 = 0 THEN 'mode is no option' END AS error FROM a""")
def coerce_params(s, d):
    e = src.load(s, d, "events")
    mode = F.when(F.col("event_id") % 3 == 0, ', "mode": "odd"}').when(F.col("event_id") % 2 == 0, ', "mode": "fast"}').otherwise("}")
    args = F.when(F.col("event_id") % 5 == 0, "{}").otherwise(F.concat(F.regexp_replace("props", r"\}$", ""), mode))
    good, rejects = facts.coerce_params(e.select("event_id", args.alias("args")), [{"key": "k", "type": "number", "required": True}, {"key": "mode", "type": "select", "options": ["fast", "slow"], "default": "slow"}])
    return good.drop("args").unionByName(rejects.drop("args"), allowMissingColumns=True)


@query("""WITH a AS (SELECT s_suppkey, s_suppkey % 3 AS n, s_suppkey % 7 = 0 AS bare, s_suppkey % 5 = 0 AS late, s_suppkey % 11 = 0 AS gone FROM supplier)
SELECT s_suppkey AS manifest_id, CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN (NOT bare)::INTEGER ELSE (NOT bare)::INTEGER + (NOT late)::INTEGER END AS n_valid, gone AS expired, NOT gone AND NOT (n >= 1 AND bare) AND NOT (n >= 2 AND late) AS valid FROM a""")
def valid_attestations(s, d):
    k = F.col("s_suppkey")
    day = lambda c: c.cast("timestamp")
    one = F.struct(F.lit("SOC2").alias("type"), F.when(k % 7 == 0, "").otherwise("https://a.example.com").alias("uri"), day(F.lit("2024-01-01")).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    two = F.struct(F.lit("ISO").alias("type"), F.lit("https://b.example.com").alias("uri"), F.lit(None).cast("timestamp").alias("valid_from"), day(F.when(k % 5 == 0, "2024-01-02").otherwise("2025-01-01")).alias("valid_until"))
    m = src.load(s, d, "supplier").select(k.alias("manifest_id"), F.slice(F.array(one, two), F.lit(1), (k % 3).cast("int")).alias("attestations"), F.when(k % 11 == 0, day(F.lit("2024-01-31"))).alias("expires_at"))
    return cat.valid_attestations(m, "2024-02-01 00:00:00")


@query("""SELECT conv_id * 1000 + turn AS case_id, contains(lower(text), 'the')::DOUBLE AS response_contains_pattern, round(CASE WHEN turn = 0 THEN 1.0 ELSE least(1.0, length(text) / (turn * 100)) END, 4)::DOUBLE AS response_min_length,
1.0::DOUBLE AS unknown, round(length(replace(text, 'x', '')) / greatest(length(text), 1), 4)::DOUBLE AS few_x, contains(lower(text), 'the') AND round(CASE WHEN turn = 0 THEN 1.0 ELSE least(1.0, length(text) / (turn * 100)) END, 4) >= 0.5 AS passed FROM conversations WHERE text <> ''""")
def register_metric(s, d):
    plugins.register_metric("few_x", lambda case: F.length(F.replace(case["response"], F.lit("x"), F.lit(""))) / F.greatest(F.length(case["response"]), F.lit(1)))
    cases = src.load(s, d, "conversations").where("text <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("text").alias("response"), F.lit("The").alias("expected_pattern"), (F.col("turn") * 100).alias("min_length"))
    return plugins.score_metrics(cases, {"response_contains_pattern": 1.0, "response_min_length": 0.5, "unknown": 1.0, "few_x": 0.0})


# bundles

_CONCEPTS_SQL = "concepts AS (SELECT lang || '/' || doc_id AS id, source AS type, '[a](../' || lang || '/' || (doc_id + 1) || '.md) [b](' || (doc_id - 1) || '.md) [c](./x/../../none/1.md) [d](e.html)' AS body, doc_id, lang FROM documents WHERE lang IS NOT NULL)"


def _concepts(s, d):
    n, lang = F.col("doc_id"), F.col("lang")
    text = lambda c: c.cast("string")
    body = F.concat(F.lit("[a](../"), lang, F.lit("/"), text(n + 1), F.lit(".md) [b]("), text(n - 1), F.lit(".md) [c](./x/../../none/1.md) [d](e.html)"))
    return _docs(s, d).where("lang is not null").select(F.concat(lang, F.lit("/"), text(n)).alias("id"), F.col("source").alias("type"), body.alias("body"))


@query(f"""WITH {_CONCEPTS_SQL}, l AS (SELECT id AS source, unnest(['../' || lang || '/' || (doc_id + 1) || '.md', (doc_id - 1) || '.md', './x/../../none/1.md']) AS link, unnest([lang || '/' || (doc_id + 1), lang || '/' || (doc_id - 1), 'none/1']) AS target FROM concepts)
SELECT source, link, target, target IN (SELECT id FROM concepts) AS found FROM l""")
def resolve_concept_links(s, d):
    return bundles.resolve_concept_links(_concepts(s, d))


@query(f"WITH {_CONCEPTS_SQL} SELECT type, count(*) AS n, min(id) AS first, max(id) AS last FROM concepts GROUP BY 1")
def concept_types(s, d):
    return bundles.concept_types(_concepts(s, d))


@query(f"WITH {_CONCEPTS_SQL} SELECT type, id FROM concepts")
def concept_index(s, d):
    return bundles.concept_index(_concepts(s, d))


@query(f"WITH {_CONCEPTS_SQL}, t AS (SELECT string_agg('- ' || type || ': ' || n, chr(10) ORDER BY type) AS t FROM (SELECT type, count(*) AS n FROM concepts WHERE type IS NOT NULL GROUP BY 1)) SELECT CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || chr(10) || '... (truncated)' ELSE t END AS overview FROM t")
def bundle_overview(s, d):
    return bundles.overview(_concepts(s, d).where("type is not null"), 60)


@query(f"WITH {_CONCEPTS_SQL} SELECT 'urn:air:example.com:knowledge:docs' AS identifier, 'docs' AS display_name, 'application/knowledge-bundle+json' AS type, '0.1' AS version, count(*) AS concept_count, list_aggregate(list_sort(list(DISTINCT type)), 'string_agg', ',') AS concept_types FROM concepts")
def bundle_entry(s, d):
    return bundles.bundle_entry(_concepts(s, d), "docs").withColumn("concept_types", F.array_join("concept_types", ","))


# whole jobs

_CANON, _KEY, _TITLE = (ORACLES[n] for n in ("canonicalise_urls", "page_key", "page_title"))
_CLEAN = "regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g')"


@query(f"""WITH c AS ({_CANON}), k AS ({_KEY}), t AS ({_TITLE}), kept AS (SELECT * FROM pages JOIN c USING (page_id) WHERE regexp_matches({_HOST}, '(^|\\.)net$') AND starts_with({_PATH}, '/en/') AND trim(html) <> ''
QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY page_id) = 1), one AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {_CLEAN} ORDER BY page_id) = 1)
SELECT page_id, canonical AS url, key, title, length({_CLEAN}) + CASE WHEN regexp_matches(html, '(?is)<meta\\b[^>]*\\bcharset\\s*=') THEN 0 ELSE length('<meta charset="utf-8">') END AS n FROM one JOIN k USING (page_id) JOIN t USING (page_id)""")
def build_web_corpus(s, d):
    a = jobs.build_web_corpus(_pages(s, d), "net", "/en/")["articles"]
    return a.select("page_id", "url", "key", "title", F.length("clean").cast("long").alias("n"))


@query(f"""WITH {_TRIPLES_SQL} SELECT 'rows nation' AS output, count(*) AS n FROM nation UNION ALL SELECT 'rows supplier', count(*) FROM supplier UNION ALL SELECT 'triples', count(*) FROM triples WHERE starts_with(s, 'nation') OR starts_with(s, 'supplier')""")
def build_graph(s, d):
    t = lambda name: src.load(s, d, name)
    return jobs.build_graph({"nation": (t("nation"), "n_nationkey", {"n_regionkey": ("in_region", "region")}, ["n_name"]), "supplier": (t("supplier"), "s_suppkey", {"s_nationkey": ("in_nation", "nation")}, ["s_name"])})["report"]


@query(f"WITH {_TRIPLES_SQL} SELECT 'customer rows' AS output, count(*) AS n FROM customer UNION ALL SELECT 'triples', count(*) FROM triples")
def import_report(s, d):
    return bundles.import_report({"customer rows": src.load(s, d, "customer"), "triples": _triples(s, d)})


@query(f"""WITH {C}, r AS (SELECT identifier, {_SCORE_SQL} AS score, 'r' || version % 3 AS registry FROM catalog UNION ALL SELECT identifier, {_SCORE_SQL}, 'z' FROM catalog WHERE version % 2 = 0),
k AS (SELECT * FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY registry ORDER BY score DESC, identifier) <= 30) SELECT identifier, max(score) AS score FROM k GROUP BY 1""")
def catalog_discovery(s, d):
    c = _catalog(s, d)
    registries = {f"r{i}": c.where(F.col("version") % 3 == i) for i in range(3)} | {"z": c.where("version % 2 = 0")}
    return jobs.catalog_discovery(registries, "al", 30)["results"].select("identifier", "score")


@query(f"""WITH {T}, {_PATCHES_SQL}, sure AS (SELECT event_id, name, ts, patch, confidence FROM patches JOIN traces USING (event_id) WHERE NOT (success AND error_count = 0 AND quality > 0.8) AND confidence >= 0.7),
j AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY name ORDER BY ts, event_id) >= 600000000, true) AS ok, count(*) OVER (PARTITION BY name ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM sure)
SELECT event_id, name, patch, confidence FROM j WHERE ok AND n < 20""")
def patch_governance(s, d):
    return jobs.patch_governance(_traces(s, d), _responses(s, d), limit=20)["allowed"].drop("ts")


_MEM_TURNS = f"have AS (SELECT 'm' || session_id || ':' || turn AS memory_id, user_id, content AS memory, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(session_id % 30 AS INTEGER)) AS updated_at FROM messages WHERE role = 'assistant')"


@query(f"""WITH {M}, {_FACTS_SQL}, {_MEM_TURNS}, new AS (SELECT 'fact:' || session_id || ':' || turn AS memory_id, user_id, content AS memory, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(session_id % 30 AS INTEGER)) AS updated_at
FROM facts WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, lower(trim(content)) ORDER BY turn) = 1),
i AS (SELECT DISTINCT memory_id, substr(memory, s, 30) AS x FROM (SELECT memory_id, memory, unnest(range(1, length(memory) - 28)) AS s FROM new WHERE length(memory) >= 30)),
t AS (SELECT memory_id, count(*) AS total FROM i GROUP BY 1), c AS (SELECT DISTINCT memory_id AS doc_id, substr(memory, s, 30) AS x FROM (SELECT memory_id, memory, unnest(range(1, length(memory) - 28)) AS s FROM have WHERE length(memory) >= 30)),
known AS (SELECT DISTINCT memory_id FROM (SELECT memory_id, doc_id, count(*) AS hits FROM i JOIN c USING (x) GROUP BY ALL) JOIN t USING (memory_id) WHERE hits >= 0.6 * total)
SELECT memory_id, user_id FROM have UNION ALL SELECT memory_id, user_id FROM new WHERE memory_id NOT IN (SELECT memory_id FROM known)""")
def curate_memory(s, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("session_id") % 30).cast("int")).cast("timestamp")
    m = _told(s, d).withColumn("ts", day)
    have = m.where("role = 'assistant'").select(F.concat(F.lit("m"), F.col("session_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("memory_id"), "user_id", F.col("content").alias("memory"), F.col("ts").alias("updated_at"))
    return jobs.curate_memory(m, have, 100, 365, "2024-02-01 00:00:00")["memories"].select("memory_id", "user_id")


_BM25 = (
    ORACLES["bm25_search"].replace("SELECT doc_id, list_filter", "SELECT conv_id || ':' || turn AS doc_id, list_filter").replace("FROM documents", "FROM conversations").replace("LIMIT 10", "LIMIT 50").replace("'thea'", "'the'").replace("'inge'", "'an'")
)


@query(f"""WITH {M}, full_text AS ({_BM25}), near AS (SELECT session_id || ':' || turn AS doc_id, round(least(1.0, ((length(content) - length(replace(lower(content), 'the an', ''))) / 6.0) / (floor(strlen(lower(content)) / 100) + 1)), 4) AS score
FROM messages WHERE contains(lower(content), 'the an') ORDER BY session_id DESC, turn DESC LIMIT 50), u AS (SELECT doc_id, score, 0 AS source FROM full_text UNION ALL SELECT doc_id, score, 1 FROM near),
f AS (SELECT doc_id, arg_min(score, source) AS score, min(source) AS source FROM u GROUP BY 1 ORDER BY source, score DESC, doc_id LIMIT 60)
SELECT doc_id AS id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview, score::DOUBLE AS score FROM f JOIN messages ON session_id || ':' || turn = doc_id
UNION ALL SELECT item_id::VARCHAR, '[Memory] ' || CASE WHEN length(text) > 190 THEN substr(text, 1, 190) || '...' ELSE text END, 0.5 FROM benchmark WHERE contains(lower(text), 'the an')""")
def recall(s, d):
    memories = src.load(s, d, "benchmark").select(F.col("item_id").alias("memory_id"), F.col("text").alias("memory"))
    return jobs.recall(_messages(s, d), memories, "the an", 60)


def embed(s, d):
    """Hashed term vectors of all documents."""
    return plugins.embed(_docs(s, d).select("doc_id", "text"), "text").drop("text")


query()(embed)
