"""Registered queries of reports, look-ups and registrations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltspark.operators import catalog as cat
from siltspark.operators import corpus as web
from siltspark.operators import reports
from siltspark.operators import sessions as ses
from siltspark.plans.registry import _TRUST_SQL, MAN, ORACLES, C, M, _catalog, _docs, _messages, _pages, _traces, query
from siltspark.sources import tables as src


@query("SELECT c_custkey AS name, max(CASE WHEN r = 5 THEN o_orderkey END) AS version, max(CASE WHEN r = 5 THEN o_orderkey END) IS NULL AS missing FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def version_lookup(s, d):
    versions = src.load(s, d, "orders").select(F.col("o_custkey").alias("name"), "o_orderkey")
    return reports.version_lookup(src.load(s, d, "customer").select(F.col("c_custkey").alias("name")), versions, "name", "o_orderkey", 5)


@query("SELECT event_type AS name, round(count(*) / nullif(sum(value), 0), 4) AS per_second FROM events GROUP BY 1")
def throughput(s, d):
    return reports.throughput(_traces(s, d).withColumn("units", F.lit(1)), "name", "units", "duration_ms")


@query(f"""WITH p AS (SELECT * FROM pages WHERE page_id % 23 <> 0 AND trim(html) <> ''), c AS (SELECT count(*) - 1 AS n, (count(*) - 1) * strlen(any_value(html)) AS b FROM p GROUP BY md5(html)),
l AS (SELECT page_id FROM ({ORACLES["extract_links"]}) WHERE page_id IN (SELECT page_id FROM p)), a AS (SELECT page_id FROM ({ORACLES["all_refs"]}) WHERE page_id IN (SELECT page_id FROM p))
SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM pages) - (SELECT count(*) FROM p) AS failed, (SELECT count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) FROM p) AS hosts,
(SELECT CAST(sum(strlen(html)) AS BIGINT) FROM p) AS bytes, (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM a) AS assets, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS duplicates, (SELECT CAST(sum(b) AS BIGINT) FROM c) AS bytes_saved""")
def crawl_totals(s, d):
    return reports.crawl_stats(_pages(s, d).withColumn("status", F.when(F.col("page_id") % 23 == 0, 503).otherwise(200)))


@query(f"""WITH {MAN}, v AS (SELECT manifest_id, {_TRUST_SQL} < 0.6 AS a, identity_type NOT IN ('spiffe', 'did', 'x509') AS b, NOT list_contains(attestations, 'SOC2-Type1') AS c FROM manifests)
SELECT manifest_id, 'LOW_TRUST_SCORE' AS violation, 'high' AS severity FROM v WHERE a UNION ALL SELECT manifest_id, 'INVALID_IDENTITY_TYPE', 'critical' FROM v WHERE b UNION ALL SELECT manifest_id, 'MISSING_CERTIFICATION', 'high' FROM v WHERE c""")
def violations(s, d):
    return cat.violations(src.read_manifests(s, d), 0.6, ["spiffe", "did", "x509"], ["SOC2-Type1"])


@query(f"""WITH {C}, u AS (SELECT CASE WHEN version % 3 = 0 THEN identifier || ':new' WHEN version % 3 = 1 THEN 'urn:air:a.b:' || (version % 7) ELSE identifier END AS identifier, identifier AS source FROM catalog)
SELECT identifier, source, identifier NOT IN (SELECT identifier FROM catalog) AND row_number() OVER (PARTITION BY identifier ORDER BY source) = 1 AS accepted FROM u""")
def register_entries(s, d):
    c = _catalog(s, d).select("identifier", "version")
    v = F.col("version") % 3
    new = F.when(v == 0, F.concat("identifier", F.lit(":new"))).when(v == 1, F.concat(F.lit("urn:air:a.b:"), (F.col("version") % 7).cast("string"))).otherwise(F.col("identifier"))
    return cat.register(c, c.select(new.alias("identifier"), F.col("identifier").alias("source")), "identifier", "source")


@query(f"WITH {M} SELECT session_id, turn, substr(content, 1, 8000) AS text, substr(content, 1, 500) AS rerank FROM messages")
def message_texts(s, d):
    return ses.message_texts(_messages(s, d))


@query(f"""WITH {M}, t AS (SELECT session_id, string_agg('## ' || role || chr(10) || content, chr(10) || chr(10) ORDER BY turn) AS t FROM messages WHERE content <> '' GROUP BY session_id)
SELECT session_id, CASE WHEN length(t) > 800 THEN concat(substr(t, 1, 800), '...') ELSE t END AS merged FROM t""")
def merge_layers(s, d):
    return ses.merge_text(_messages(s, d), 200, title="role")


@query(f"""WITH {M}, c AS (SELECT session_id * 1000 + turn AS case_id, session_id, turn + 1 AS turn FROM messages WHERE role = 'user'), r AS (SELECT case_id, coalesce(content, '') AS x FROM c LEFT JOIN (SELECT * FROM messages WHERE role = 'assistant') m USING (session_id, turn))
SELECT case_id, contains(lower(x), 'the')::DOUBLE AS pattern, round(least(1.0, length(x) / 200), 4)::DOUBLE AS min_length, (trim(x) <> '')::DOUBLE AS not_empty, contains(lower(x), 'the') AND least(1.0, round(length(x) / 200, 4)) >= 1 AND trim(x) <> '' AS passed FROM r""")
def score_responses(s, d):
    m = _messages(s, d)
    case = lambda role, back: m.where(F.col("role") == role).select((F.col("session_id") * 1000 + F.col("turn") - back).alias("case_id"), F.col("content").alias("response"))
    return ses.score_eval(ses.with_responses(case("user", 0).select("case_id"), case("assistant", 1)), "the", 200)


_PATH_SQL = "CASE doc_id % 5 WHEN 0 THEN 'a/vendor/x.txt' WHEN 1 THEN 'a/b.pyc' WHEN 2 THEN 'lib.tar.gz' WHEN 3 THEN 'vendored/x' ELSE 'a/b.py' END"


@query(f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE doc_id % 5 >= 3)
WHERE regexp_matches(line, '[Rr]eserved')""")
def grep_paths(s, d):
    return web.grep(_docs(s, d).withColumn("path", F.expr(_PATH_SQL)), "[Rr]eserved", path="path")


@query(f"WITH m AS ({ORACLES['mime_counter']}) SELECT string_agg(mime || '=' || n, ';' ORDER BY mime) AS counter FROM m")
def mime_string(s, d):
    return web.mime_string(web.mime_counter(_pages(s, d)))


@query(f"""WITH k AS ({ORACLES['page_key']}), h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN host = regexp_replace(host, '^(www|m|blog)[.]', '') THEN key ELSE host || '/' || key END AS key FROM k JOIN h USING (page_id)""")
def site_keys(s, d):
    site = F.regexp_replace(web.host(F.col("url")), "^(www|m|blog)[.]", "")
    return _pages(s, d).select("page_id", web.page_key(F.col("url"), site).alias("key"))
