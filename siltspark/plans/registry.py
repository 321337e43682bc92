"""The registered queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.operators import catalog as cat
from siltspark.operators import corpus as web
from siltspark.operators import containment, graph, patterns, reports, search
from siltspark.operators import sessions as ses
from siltspark.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"

M = "messages AS (SELECT conv_id AS session_id, conv_id % 10 AS user_id, turn, role, text AS content FROM conversations)"
C, T, MEM, MAN = src.CATALOG_SQL, src.TRACES_SQL, src.MEMORIES_SQL, src.MANIFESTS_SQL
SHARE_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_messages, _catalog, _traces = src.read_messages, src.read_catalog_entries, src.read_traces
_docs = lambda s, d: src.load(s, d, "documents")
_pages = lambda s, d: src.load(s, d, "pages")

# search


@query(f"""WITH d AS (SELECT doc_id, {SHARE_SQL} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE starts_with(term, 'thea') OR starts_with(term, 'inge') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS score FROM tf JOIN df USING (term), st
GROUP BY doc_id HAVING bool_or(starts_with(term, 'thea')) AND bool_or(starts_with(term, 'inge')) ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_search(s, d):
    return search.bm25_search(_docs(s, d), "doc_id", "text", "thea inge", 10)


_DATA = f"""{M}, d AS (SELECT session_id, turn, {SHARE_SQL.replace('text', 'content')} AS w FROM messages)"""


@query(f"""WITH {_DATA}, st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
tf AS (SELECT session_id, turn, dl, term, count(*) AS tf FROM (SELECT session_id, turn, len(w) AS dl, unnest(w) AS term FROM d) WHERE starts_with(term, 'th') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT session_id || ':' || turn AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS score FROM tf JOIN df USING (term), st
WHERE session_id % 5 = 2 GROUP BY session_id, turn ORDER BY score DESC, id LIMIT 20""")
def session_search(s, d):
    m = _messages(s, d).withColumn("id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string")))
    return search.bm25_search(m, "id", "content", "th", 20, within=F.col("session_id") % 5 == 2)


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({SHARE_SQL}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_stats(s, d):
    return search.term_stats(_docs(s, d), "doc_id", "text")


@query(f"""WITH {M} SELECT session_id, turn, round(least(1.0, ((length(content) - length(replace(lower(content), 'the', ''))) / 3.0) / (floor(strlen(lower(content)) / 100) + 1)), 4) AS score
FROM messages WHERE contains(lower(content), 'the') ORDER BY session_id DESC, turn DESC LIMIT 50""")
def like_search(s, d):
    return search.like_search(_messages(s, d), "the", 50)


def _vectors(s, d):
    return src.load(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.id AS q_id, b.id AS b_id, round(list_cosine_similarity(q.v, b.v), 4) AS score FROM e q JOIN e b ON q.id <> b.id WHERE q.id % 50 = 0)
SELECT q_id, b_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id) AS rank FROM p) WHERE rank <= 10""")
def knn(s, d):
    v = _vectors(s, d)
    return search.knn(v.where("id % 50 = 0"), v, 10)


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT b.id, round(list_cosine_similarity(q.v, b.v), 4) AS score FROM e q JOIN e b ON q.id <> b.id WHERE q.id = 7 ORDER BY score DESC, b.id LIMIT 10""")
def similar(s, d):
    v = _vectors(s, d)
    return search.knn(v.where("id = 7"), v, 10).select(F.col("b_id").alias("id"), "score")


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT b.id, round(list_cosine_similarity(q.v, b.v), 4) AS score FROM e q, e b WHERE q.id = 3 ORDER BY score DESC, b.id LIMIT 5""")
def vector_search(s, d):
    v = _vectors(s, d)
    return search.knn(v.where("id = 3"), v, 5, same=True).select(F.col("b_id").alias("id"), "score")


@query("""WITH l AS (SELECT p_partkey AS id, round(p_size / 50.0, 4) AS score FROM part WHERE p_size > 20), e AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 4) AS score FROM embeddings)
SELECT id, round(0.7 * coalesce(l.score, 0) + 0.3 * coalesce(e.score, 0), 6) AS score FROM l FULL JOIN e USING (id)""")
def fuse(s, d):
    lex = src.load(s, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 50.0, 4).alias("score"))
    sem = src.load(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double"), 4).alias("score"))
    return search.fuse(lex, sem, 0.3)


@query("""WITH l AS (SELECT p_partkey AS id, p_size * 1.0 AS score FROM part WHERE p_size = 50), e AS (SELECT p_partkey AS id, p_size * 1.0 AS score FROM part WHERE p_size >= 49)
SELECT id, CAST(score AS DOUBLE) AS score FROM (SELECT id, score, 0 AS src FROM l UNION ALL SELECT id, score, 1 FROM e WHERE id NOT IN (SELECT id FROM l)) ORDER BY src, score DESC, id LIMIT 60""")
def fill(s, d):
    p = src.load(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    return search.fill(p.where("score = 50"), p.where("score >= 49"), 60).select("id", "score")


# sessions


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS preview FROM documents")
def preview(s, d):
    return _docs(s, d).select("doc_id", ses.preview(F.col("text")).alias("preview"))


@query(f"WITH {M} SELECT * FROM messages WHERE user_id = 3 AND session_id = 13")
def scope(s, d):
    return ses.scope(_messages(s, d), user=3, session=13)


@query(f"WITH {M} SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 3")
def cap_per_session(s, d):
    return ses.newest(_messages(s, d), "session_id", "turn", 3)


@query(f"""WITH {M} SELECT session_id, CAST(count_if(role = 'user') AS BIGINT) AS n_user, CAST(count_if(role = 'assistant') AS BIGINT) AS n_assistant, CAST(count_if(role = 'tool') AS BIGINT) AS n_tool,
CAST(sum(CASE WHEN role IN ('user', 'assistant') THEN length(content) ELSE 0 END) AS BIGINT) AS total_chars,
CAST(coalesce(floor(sum(CASE WHEN role IN ('user', 'assistant') THEN length(content) ELSE 0 END) / nullif(count_if(role IN ('user', 'assistant')), 0)), 0) AS BIGINT) AS avg_chars FROM messages GROUP BY session_id""")
def session_stats(s, d):
    return ses.session_stats(_messages(s, d))


@query("SELECT conv_id AS session_id, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY 1")
def session_list(s, d):
    return reports.session_list(_messages(s, d))


@query(f"WITH {M} SELECT DISTINCT session_id FROM messages WHERE user_id = 4 ORDER BY session_id DESC LIMIT 50")
def list_sessions(s, d):
    return reports.list_sessions(_messages(s, d), 4)


@query(f"WITH {M} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role, content FROM messages WHERE role <> 'system' AND trim(content) <> ''")
def export_sessions(s, d):
    return src.export_sessions(_messages(s, d))


@query(f"""WITH {M}, m AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS r FROM messages)
SELECT session_id, turn, role, content FROM m WHERE NOT (n > 4 AND r <= n // 2)
UNION ALL SELECT session_id, -1, 'system', concat(count(*), ' messages, ~', sum(length(content) // 4), ' tokens') FROM m WHERE n > 4 AND r <= n // 2 GROUP BY session_id""")
def compact_history(s, d):
    return ses.compact_history(_messages(s, d), least=4)


@query(f"""WITH {M}, r AS (SELECT session_id, turn, CAST(sum(length(content) // 4) OVER w AS BIGINT) AS tokens, count(*) OVER w AS n FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT session_id, turn, tokens, tokens > 400 * 0.7 OR n > 100 AS revise FROM r""")
def within_budget(s, d):
    return ses.within_budget(_messages(s, d), 400)


@query(f"""WITH {M}, t AS (SELECT session_id, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS t FROM messages WHERE content <> '' GROUP BY session_id)
SELECT session_id, CASE WHEN length(t) > 2000 THEN concat(substr(t, 1, 2000), '...') ELSE t END AS merged FROM t""")
def merge_text(s, d):
    return ses.merge_text(_messages(s, d), 500)


_STARTS = """regexp_matches(lower(trim(content)), '^(what|how|when|where|who|why|can you|could you|will you|would you|hello|hi |hey|good morning|good afternoon|thanks|thank you|ok|okay|yes|no|yep|nope|什么|怎么|为什么|你好|谢谢|可以|能不能|能否)')"""


@query(f"WITH {M} SELECT session_id, turn, length(lower(trim(content))) < 20 OR {_STARTS} AS transient FROM messages")
def is_transient(s, d):
    return _messages(s, d).select("session_id", "turn", ses.is_transient(F.col("content")).alias("transient"))


@query(f"""WITH {MEM}, m AS (SELECT memory_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, epoch(TIMESTAMP '{NOW}' - updated_at) / 86400.0 AS age,
 round(0.7 * greatest(0.0, 1 - (trunc(epoch(TIMESTAMP '{NOW}')) - floor(epoch(updated_at))) / 86400.0 / 365) + 0.3 * least(length(memory) / 500.0, 1.0), 6) AS importance FROM memories),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, memory_id) AS r FROM m WHERE (age - 0) <= 20)
SELECT memory_id, user_id, importance FROM r WHERE n <= 0.8 * 60 OR r <= 0.6 * 60""")
def evict(s, d):
    return ses.evict(src.read_memories(s, d), 60, 20, NOW)


@query(f"WITH {MEM} SELECT user_id, count(*) AS total, CAST(min(updated_at) AS VARCHAR) AS oldest, CAST(max(updated_at) AS VARCHAR) AS newest, 1000 AS capacity FROM memories GROUP BY user_id")
def memory_health(s, d):
    return reports.memory_health(src.read_memories(s, d), 1000)


@query("""WITH i AS (SELECT DISTINCT item_id, substr(text, s, 30) AS x FROM (SELECT item_id, text, unnest(range(1, length(text) - 28)) AS s FROM benchmark WHERE length(text) >= 30)),
t AS (SELECT item_id, count(*) AS total FROM i GROUP BY 1), c AS (SELECT DISTINCT doc_id, substr(text, s, 30) AS x FROM (SELECT doc_id, text, unnest(range(1, length(text) - 28)) AS s FROM documents WHERE length(text) >= 30)),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM i JOIN c USING (x) GROUP BY ALL)
SELECT item_id, doc_id, round(hits / total, 4) AS share FROM h JOIN t USING (item_id) WHERE hits >= 0.6 * total""")
def contained_in(s, d):
    return containment.contained_in(src.load(s, d, "benchmark"), _docs(s, d))


# calls, traces, versions


@query(f"""WITH {T} SELECT name, count(*) AS calls, CAST(count_if(success) AS BIGINT) AS ok, CAST(count_if(NOT success) AS BIGINT) AS errors, round(sum(duration_ms), 2) AS total_ms,
round(arg_max(duration_ms, (ts, event_id)), 4) AS last_ms, arg_max(CASE WHEN success THEN '' ELSE 'error' END, (ts, event_id)) AS last_error, CAST(max(ts) AS VARCHAR) AS last_call FROM traces GROUP BY name""")
def call_metrics(s, d):
    return ses.call_metrics(_traces(s, d))


@query(f"WITH {T} SELECT event_id FROM traces WHERE NOT (success AND error_count = 0 AND quality > 0.8)")
def needs_analysis(s, d):
    return reports.needs_analysis(_traces(s, d)).select("event_id")


@query("SELECT user_id, event_type AS name, count(*) AS n FROM events GROUP BY ALL")
def tool_usage(s, d):
    return reports.tool_usage(_traces(s, d))


@query("""WITH d AS (SELECT event_type AS name, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT name, count(*) AS n, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(max(CASE WHEN r = c // 2 + 1 THEN v END), 4) AS median, round(stddev_pop(v), 4) AS stddev FROM d GROUP BY name""")
def latency_stats(s, d):
    return ses.latency_stats(_traces(s, d), "name", "duration_ms")


@query("""SELECT event_type AS name, count(DISTINCT user_id) AS registries, count(*) AS entries, round(avg(value), 4) AS latency, round(count_if(value > 90) / count(DISTINCT user_id), 4) AS error_rate FROM events GROUP BY 1""")
def federation_stats(s, d):
    return reports.federation_stats(_traces(s, d), 90)


@query(f"""WITH {T} SELECT event_id, name, count(*) OVER (PARTITION BY name ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n,
count(*) OVER (PARTITION BY name ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) < 60 AS allowed FROM traces WHERE quality > 0.05""")
def rolling_count(s, d):
    return ses.rolling_count(_traces(s, d).withColumn("applied", F.col("quality") > 0.05), 24, 60)


@query(f"WITH {T} SELECT event_id, name, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY name ORDER BY ts, event_id) >= 600000000, true) AS ok FROM traces")
def cooldown_ok(s, d):
    return ses.cooldown_ok(_traces(s, d), 600)


@query(f"""WITH {T}, g AS (SELECT event_id, name, ts, sha256(concat(name, '|', event_id)) AS signature FROM traces)
SELECT event_id, name, signature, lag(signature) OVER (PARTITION BY name ORDER BY ts, event_id) AS previous FROM g""")
def chain(s, d):
    return ses.chain(_traces(s, d))


@query("SELECT CASE max(CASE WHEN value > 99 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' WHEN 0 THEN 'healthy' ELSE 'unknown' END AS status FROM events")
def health_rollup(s, d):
    v = F.col("duration_ms")
    return ses.health_rollup(_traces(s, d).select(F.when(v > 99, "unhealthy").when(v > 50, "degraded").otherwise("healthy").alias("status")))


@query("""SELECT conv_id * 1000 + turn AS case_id, contains(lower(text), 'the')::DOUBLE AS pattern, round(least(1.0, length(text) / 200), 4)::DOUBLE AS min_length, (trim(text) <> '')::DOUBLE AS not_empty,
contains(lower(text), 'the') AND least(1.0, round(length(text) / 200, 4)) >= 1 AND trim(text) <> '' AS passed FROM conversations WHERE role = 'assistant'""")
def score_eval(s, d):
    return ses.score_eval(_cases(s, d), "the", 200)


def _cases(s, d):
    m = _messages(s, d).where("role = 'assistant'")
    return m.select((F.col("session_id") * 1000 + F.col("turn")).alias("case_id"), F.col("content").alias("response"))


@query("""SELECT CAST(count_if(p) AS BIGINT) AS passed, count(*) AS total, round(100.0 * count_if(p) / greatest(count(*), 1), 4)::DOUBLE AS percent
FROM (SELECT contains(text, 'the') AND round(length(text) / 200, 4) >= 1 AND trim(text) <> '' AS p FROM conversations WHERE role = 'assistant')""")
def eval_summary(s, d):
    return ses.eval_summary(ses.score_eval(_cases(s, d), "the", 200, cased=True))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3")
def prune_versions(s, d):
    return ses.newest(src.load(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SELECT c_custkey, coalesce(max(o_orderkey), 0) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def current_version(s, d):
    return reports.current_version(src.load(s, d, "customer"), src.load(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 2")
def version_at(s, d):
    return reports.version_at(src.load(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2)


@query("SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def first_seen(s, d):
    return ses.first_seen(_docs(s, d).select("doc_id", F.md5("text").alias("h")), F.col("h"), "doc_id")


# catalog


@query(f"WITH {C} SELECT identifier FROM catalog WHERE list_has_any(capabilities, ['Brand#11', 'Brand#22', 'Brand#33']) AND (contains(lower(display_name), 'a') OR contains(lower(description), 'a'))")
def catalog_filter(s, d):
    return cat.catalog_filter(_catalog(s, d), capabilities=["Brand#11", "Brand#22", "Brand#33"], query="A").select("identifier")


@query(f"WITH {C} SELECT identifier FROM catalog WHERE split_part(identifier, ':', 3) = 'brand-11.example.com' AND (contains(lower(display_name), 'e') OR contains(lower(description), 'e') OR len(list_filter(list_concat(tags, capabilities), lambda x: contains(lower(x), 'e'))) > 0)")
def explore_filter(s, d):
    return cat.explore_filter(_catalog(s, d), publisher_is="brand-11.example.com", query="e").select("identifier")


@query(f"""WITH {C} SELECT facet, value, count(*) AS n FROM (SELECT 'type' AS facet, type AS value FROM catalog UNION ALL SELECT 'tag', unnest(tags) FROM catalog
UNION ALL SELECT 'capability', unnest(capabilities) FROM catalog UNION ALL SELECT 'publisher', split_part(identifier, ':', 3) FROM catalog) GROUP BY ALL""")
def facets(s, d):
    return cat.facets(_catalog(s, d))


@query(f"WITH {C} SELECT type, count(*) AS n, string_agg(display_name, '|' ORDER BY display_name) AS members FROM catalog GROUP BY type")
def browse(s, d):
    return cat.browse(_catalog(s, d), "type")


@query(f"WITH {C} SELECT DISTINCT unnest(tags) AS value FROM catalog")
def distinct_values(s, d):
    return cat.distinct_values(_catalog(s, d), "tags")


_SCORE_SQL = """round(CASE WHEN contains(lower(display_name), 'al') THEN 0.4 ELSE 0 END + CASE WHEN contains(lower(description), 'al') THEN 0.3 ELSE 0 END
 + CASE WHEN len(list_filter(tags, lambda x: contains(lower(x), 'al'))) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(list_filter(capabilities, lambda x: contains(lower(x), 'al'))) > 0 THEN 0.1 ELSE 0 END, 4)::DOUBLE"""


@query(f"WITH {C}, r AS (SELECT identifier, {_SCORE_SQL} AS score FROM catalog) SELECT * FROM r WHERE score > 0 ORDER BY score DESC, identifier LIMIT 50 OFFSET 10")
def catalog_search(s, d):
    return cat.catalog_search(_catalog(s, d), "al", 10, 50)


@query(f"WITH {C} SELECT identifier, display_name FROM catalog ORDER BY display_name DESC, identifier LIMIT 20 OFFSET 40")
def explore_sort(s, d):
    return cat.page(_catalog(s, d).select("identifier", "display_name"), [F.desc("display_name"), F.col("identifier")], 40)


@query(f"""WITH {C}, r AS (SELECT identifier, {_SCORE_SQL} + round(version % 7 / 100.0, 4) AS score, version % 4 AS registry FROM catalog UNION ALL SELECT identifier, {_SCORE_SQL}, 10 + version % 3 FROM catalog),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY registry ORDER BY score DESC, identifier) <= 50)
SELECT identifier, round(max(score), 4) AS score, arg_max(registry, (score, -registry)) AS registry FROM k GROUP BY identifier""")
def federated_search(s, d):
    c = _catalog(s, d)
    base = F.round(cat.catalog_score("al"), 4)
    one = c.select("identifier", (base + F.round(F.col("version") % 7 / 100.0, 4)).alias("score"), (F.col("version") % 4).alias("registry"))
    two = c.select("identifier", base.alias("score"), (10 + F.col("version") % 3).alias("registry"))
    return cat.federated_search(one.unionByName(two), 50).withColumn("score", F.round("score", 4))


@query(f"WITH {C} SELECT identifier, CASE WHEN version % 5 = 0 THEN version + 1 ELSE version END AS version FROM catalog")
def upsert(s, d):
    c = _catalog(s, d).select("identifier", "version")
    return cat.upsert(c, c.where("version % 5 = 0").withColumn("version", F.col("version") + 1), "identifier", "version")


@query(f"WITH {C} SELECT identifier FROM catalog WHERE version % 3 <> 0")
def remove(s, d):
    c = _catalog(s, d).select("identifier", "version")
    return cat.remove(c, c.where("version % 3 = 0"), "identifier").select("identifier")


@query(f"WITH {C} SELECT identifier, split_part(identifier, ':', 3) AS publisher, split_part(identifier, ':', 4) AS namespace, split_part(identifier, ':', 5) AS name FROM catalog")
def urn_parts(s, d):
    u = cat.urn_parts(F.col("identifier"))
    return _catalog(s, d).select("identifier", u["publisher"].alias("publisher"), u["namespace"].alias("namespace"), u["name"].alias("name"))


@query(f"""WITH {C} SELECT identifier, CASE WHEN version % 10 = 0 THEN 'url or data' WHEN version % 10 = 1 THEN 'display_name' ELSE '' END AS reasons FROM catalog""")
def validate_entries(s, d):
    v = F.col("version") % 10
    c = _catalog(s, d).withColumns({"data": F.when(v == 0, "{}"), "display_name": F.when(v == 1, " ").otherwise(F.col("display_name"))})
    return cat.validate_entries(c).select("identifier", F.array_join("reasons", ",").alias("reasons"))


_TRUST_SQL = """round(least(1.0, 0.2 + CASE identity_type WHEN 'spiffe' THEN 0.3 WHEN 'did' THEN 0.25 WHEN 'x509' THEN 0.2 WHEN 'dns' THEN 0.15 ELSE 0.1 END + 0.1 * len(attestations) + CASE WHEN trusted THEN 0.2 ELSE 0 END), 4)::DOUBLE"""


@query(f"WITH {MAN} SELECT manifest_id, {_TRUST_SQL} AS score FROM manifests")
def trust_score(s, d):
    return cat.trust_score(src.read_manifests(s, d)).select("manifest_id", "score")


@query(f"WITH {MAN}, r AS (SELECT unnest(['SOC2-Type2', 'ISO27001']) AS missing) SELECT manifest_id, missing FROM manifests, r WHERE NOT list_contains(attestations, missing)")
def missing_required(s, d):
    return cat.missing_required(src.read_manifests(s, d), ["SOC2-Type2", "ISO27001"])


@query(f"""WITH {MAN}, v AS (SELECT manifest_id, concat_ws(',', CASE WHEN {_TRUST_SQL} < 0.6 THEN 'LOW_TRUST_SCORE' END, CASE WHEN identity_type NOT IN ('spiffe', 'did', 'x509') THEN 'INVALID_IDENTITY_TYPE' END,
CASE WHEN NOT list_contains(attestations, 'SOC2-Type1') THEN 'MISSING_CERTIFICATION' END) AS violations FROM manifests)
SELECT manifest_id, violations, violations = '' AS compliant, CASE WHEN violations = '' THEN 1.0 ELSE 0.0 END::DOUBLE AS compliance_score FROM v""")
def compliance(s, d):
    return cat.compliance(src.read_manifests(s, d), 0.6, ["spiffe", "did", "x509"], ["SOC2-Type1"])


# corpus


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS canonical FROM pages""")
def canonicalise_urls(s, d):
    return _pages(s, d).select("page_id", web.canonical_url(F.col("url")).alias("canonical"))


@query(r"""WITH p AS (SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
l AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS leaf, CASE WHEN q <> '' THEN '__q-' || substr(sha256(q), 1, 6) ELSE '' END AS mark FROM p)
SELECT page_id, CASE WHEN path = '' OR ends_with(path, '/') THEN path || 'index.html' WHEN contains(leaf, '.') THEN regexp_replace(path, '\.[^./]*$', '') || mark || regexp_extract(leaf, '(\.[^.]*)$', 1) ELSE path || mark || '.html' END AS key FROM l""")
def page_key(s, d):
    return _pages(s, d).select("page_id", web.page_key(F.col("url")).alias("key"))


_LINKS_SQL = """links AS (SELECT DISTINCT page_id, url, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END AS target
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]+)"[^>]*>', 1)) AS href FROM pages) WHERE starts_with(href, '/') OR regexp_matches(href, '^[a-z]+://'))"""


@query(f"WITH {_LINKS_SQL} SELECT * FROM links")
def extract_links(s, d):
    return web.extract_links(_pages(s, d))


@query(f"WITH {_LINKS_SQL} SELECT regexp_extract(target, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n, count(DISTINCT page_id) AS pages FROM links GROUP BY 1")
def link_hosts(s, d):
    return reports.link_hosts(_pages(s, d))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(s, d):
    return _pages(s, d).select("page_id", web.page_title(F.col("html")).alias("title"))


#: Pages with each construct once, and what a cleaned page has instead.
_DIRTY = (
    ('<head><title>t</title></head><p onclick="a>b()" ONLOAD=go>x</p>', '<head><meta charset="utf-8"><title>t</title></head><p>x</p>', 0, 2, 0, 0, 0, 1),
    ('<meta charset=utf-8><applet code=x>y</applet>one on = two', '<meta charset=utf-8>one on = two', 0, 0, 0, 0, 1, 0),
    ('<meta charset="x"><link rel="preload" as="script" href="/a"><link rel=stylesheet href=/b.css><link rel="dns-prefetch" href=//c><link rel=prefetch href="/d.js">', '<meta charset="x"><link rel=stylesheet href=/b.css>', 0, 0, 0, 3, 0, 0),
    ('<meta charset="x"><a href=" javascript:f()">k</a><img src=javascript:g() alt=z><form action="javascript:h()">', '<meta charset="x"><a href="#">k</a><img alt=z><form>', 0, 0, 3, 0, 0, 0),
    ('<script>a</script>b<SCRIPT src=c></SCRIPT><!--[if IE]><i><![endif]--><iframe src=d></iframe>', '<meta charset="utf-8">b', 2, 0, 0, 0, 0, 1),
)


@query(
    "SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>')) AS INTEGER) AS n_script, CAST(len(regexp_extract_all(html, '(?is)<[a-z][^<>]*\\son[a-z]+\\s*=')) AS INTEGER) AS n_handler, "
    "CAST(len(regexp_extract_all(html, '(?is)=\\s*[\"'']?\\s*javascript:')) AS INTEGER) AS n_js, CAST(len(regexp_extract_all(html, '(?is)<link\\b[^>]*rel=.?(preconnect|dns-prefetch|modulepreload)')) AS INTEGER) AS n_dead, "
    "CAST(len(regexp_extract_all(html, '(?is)<applet')) AS INTEGER) AS n_applet, CAST(NOT regexp_matches(html, '(?is)<meta\\b[^>]*\\bcharset\\s*=') AS INTEGER) AS n_charset, NULL AS clean FROM pages UNION ALL FROM (VALUES "
    + ", ".join(f"({-1 - k}, {', '.join(map(str, x[2:]))}, '{x[1]}')" for k, x in enumerate(_DIRTY)) + ")"
)
def clean_pages(s, d):
    dirty = s.createDataFrame([(-1 - k, x[0]) for k, x in enumerate(_DIRTY)], "page_id long, html string")
    cleaned = web.clean_pages(_pages(s, d).select("page_id", "html").unionByName(dirty))
    n_js = (F.col("n_js_url") + F.col("n_js_link")).alias("n_js")
    return cleaned.select("page_id", "n_script", "n_handler", n_js, F.col("n_dead_link").alias("n_dead"), "n_applet", "n_charset", F.when(F.col("page_id") < 0, F.col("html")).alias("clean"))


@query("""WITH u AS (SELECT page_id, 0 AS k, url FROM pages UNION ALL SELECT page_id, 1, url || '.PDF' FROM pages UNION ALL SELECT page_id, 2, url || '/a.m4a?q=x.html' FROM pages)
SELECT page_id, k, CASE WHEN regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(?i)\\.(pdf|doc|docx|xlsx|zip|tar|gz|bz2|7z|rar|exe|dmg|png|jpg|jpeg|gif|svg|ico|webp|avif|css|js|json|xml|woff|woff2|ttf|otf|eot|mp3|mp4|webm|ogg|wav|flac|avi|mov|m4v|m4a)$') THEN 'asset' ELSE 'page' END AS kind FROM u""")
def url_kinds(s, d):
    p = _pages(s, d).select("page_id", "url")
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.concat("url", F.lit(x)).alias("u")) for k, x in enumerate(("", ".PDF", "/a.m4a?q=x.html"))])).alias("x")
    return p.select("page_id", every).select("page_id", "x.k", web.url_kind(F.col("x.u")).alias("kind"))


_HOPS = """a AS (SELECT c_custkey AS url, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN c_custkey - 1 WHEN 2 THEN c_custkey - 1 WHEN 3 THEN c_custkey + 1 WHEN 4 THEN c_custkey - 1 ELSE -c_custkey END AS nxt FROM customer)"""


@query(f"""WITH RECURSIVE {_HOPS}, h AS (SELECT url, nxt, 0 AS k FROM a UNION ALL SELECT h.url, coalesce(a.nxt, h.nxt), k + 1 FROM h LEFT JOIN a ON a.url = h.nxt WHERE k < 8)
SELECT h.url, h.nxt AS target, CASE WHEN h.nxt IS NULL THEN 'ok' WHEN a.url IS NULL THEN 'missing' WHEN a.nxt IS NULL THEN 'ok' ELSE 'loop' END AS reason FROM h LEFT JOIN a ON a.url = h.nxt WHERE k = 8""")
def redirect_chains(s, d):
    c = F.col("c_custkey")
    to = F.when(c % 6 == 0, None).when(c % 6 == 3, c + 1).when(c % 6 == 5, -c).otherwise(c - 1)
    return web.resolve_redirects(src.load(s, d, "customer").select(c.alias("url"), to.alias("to")))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum((n - 1) * size) AS BIGINT) AS bytes_saved FROM (SELECT sha256(text) AS h, count(*) AS n, any_value(strlen(text)) AS size FROM documents GROUP BY 1)")
def dedup_stats(s, d):
    return web.dedup_stats(_docs(s, d))


@query("""WITH n AS (SELECT url, md5(CASE WHEN page_id % 7 = 0 THEN concat(html, '<!-- v2 -->') ELSE html END) AS now FROM pages WHERE page_id % 11 <> 0), o AS (SELECT url, md5(html) AS was FROM pages WHERE page_id % 13 <> 0)
SELECT url, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN was = now THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (url)""")
def diff_snapshots(s, d):
    p = _pages(s, d)
    new = p.where("page_id % 11 <> 0").withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("<!-- v2 -->"))).otherwise(F.col("html")))
    return web.diff_snapshots(p.where("page_id % 13 <> 0"), new)


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) IN ('tionsh.example.net') AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/') AS inside FROM pages""")
def in_scope(s, d):
    return _pages(s, d).select("page_id", web.in_scope(F.col("url"), "tionsh.example.net", False, "/en/", ["/private"]).alias("inside"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT DISTINCT host, unnest([{'p': '/en/', 'a': false}, {'p': '/', 'a': true}, {'p': '/en/1', 'a': true}], recursive := true) FROM u)
SELECT page_id, coalesce(arg_max(a, length(p)), true) AS allowed FROM u LEFT JOIN r ON u.host = r.host AND starts_with(path, p) GROUP BY page_id""")
def robots_allowed(s, d):
    u = _pages(s, d).select("page_id", web.host(F.col("url")).alias("host"), web._part(F.col("url"), 3).alias("path"))
    rules = F.array(*[F.struct(F.lit(p).alias("rule_path"), F.lit(a).alias("allow")) for p, a in (("/en/", False), ("/", True), ("/en/1", True))])
    return web.robots_allowed(u, u.select("host").distinct().select("host", F.inline(rules)))


@query("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE regexp_matches(line, '[Rr]eserved')")
def grep(s, d):
    return web.grep(_docs(s, d), "[Rr]eserved")


@query("""WITH r AS (SELECT md5(concat_ws('|', url, md5(html))) AS d FROM pages), p AS (SELECT substr(d, 1, 3) AS p, md5(string_agg(d, '' ORDER BY d)) AS d FROM r GROUP BY 1) SELECT md5(string_agg(d, '' ORDER BY p)) AS fingerprint FROM p""")
def fingerprint(s, d):
    return web.fingerprint(_pages(s, d))


@query("SELECT count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS hosts FROM pages")
def crawl_stats(s, d):
    return _pages(s, d).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("bytes"), F.countDistinct(web.host(F.col("url"))).alias("hosts"))


@query("""WITH b AS (SELECT page_id, url, CASE WHEN page_id % 17 = 0 THEN 403 WHEN page_id % 17 = 1 THEN 429 ELSE 200 END AS status, CASE WHEN page_id % 17 = 2 THEN '' WHEN page_id % 17 = 3 THEN 'Access DENIED' WHEN page_id % 17 = 4 THEN concat(html, 'CAPTCHA') ELSE html END AS html FROM pages),
r AS (SELECT url, CASE WHEN status = 403 THEN 'forbidden' WHEN status = 429 THEN 'rate limited' WHEN trim(html) = '' THEN 'empty' WHEN length(html) < 200 AND contains(lower(html), 'denied') THEN 'denied' WHEN contains(lower(html), 'captcha') THEN 'captcha' END AS reason FROM b)
SELECT reason, count(*) AS events, count(DISTINCT url) AS urls FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def block_report(s, d):
    k = F.col("page_id") % 17
    html = F.when(k == 2, "").when(k == 3, "Access DENIED").when(k == 4, F.concat("html", F.lit("CAPTCHA"))).otherwise(F.col("html"))
    p = _pages(s, d).select("url", F.when(k == 0, 403).when(k == 1, 429).otherwise(200).alias("status"), html.alias("html"))
    return reports.block_report(p)


@query("""WITH p(pattern, risk) AS (VALUES ('Rights Reserved', 'license'), ('password', 'secret'), ('AKIA', 'secret')) SELECT doc_id, pattern, risk FROM documents JOIN p ON contains(lower(text), lower(pattern))""")
def scan_commands(s, d):
    rows = s.createDataFrame([("Rights Reserved", "license"), ("password", "secret"), ("AKIA", "secret")], "pattern string, risk string")
    return patterns.scan_commands(_docs(s, d), rows)


# graph

_TRIPLES_SQL = """triples AS (SELECT concat('nation/', n_nationkey) AS s, 'in_region' AS p, concat('region/', n_regionkey) AS o FROM nation UNION ALL SELECT concat('nation/', n_nationkey), 'n_name', n_name FROM nation
UNION ALL SELECT concat('region/', r_regionkey), 'r_name', r_name FROM region UNION ALL SELECT concat('supplier/', s_suppkey), 'in_nation', concat('nation/', s_nationkey) FROM supplier UNION ALL SELECT concat('supplier/', s_suppkey), 's_name', s_name FROM supplier
UNION ALL SELECT concat('customer/', c_custkey), 'in_nation', concat('nation/', c_nationkey) FROM customer)"""


def _triples(s, d):
    t = lambda name: src.load(s, d, name)
    return graph.union(
        graph.relations(t("nation"), "nation", "n_nationkey", {"n_regionkey": ("in_region", "region")}, ["n_name"]), graph.relations(t("region"), "region", "r_regionkey", {}, ["r_name"]),
        graph.relations(t("supplier"), "supplier", "s_suppkey", {"s_nationkey": ("in_nation", "nation")}, ["s_name"]), graph.relations(t("customer"), "customer", "c_custkey", {"c_nationkey": ("in_nation", "nation")}, []),
    )


@query(f"WITH {_TRIPLES_SQL} SELECT * FROM triples")
def relations_from_fks(s, d):
    return _triples(s, d)


@query(f"WITH {_TRIPLES_SQL} SELECT count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(*) AS triples FROM triples")
def graph_stats(s, d):
    return graph.graph_stats(_triples(s, d))


@query(f"WITH {_TRIPLES_SQL} SELECT a.s AS who, b.s AS nation, c.o AS region FROM triples a JOIN triples b ON a.o = b.s JOIN triples c ON c.s = b.o WHERE a.p = 'in_nation' AND b.p = 'in_region' AND c.p = 'r_name'")
def match(s, d):
    return graph.match(_triples(s, d), [("?who", "in_nation", "?nation"), ("?nation", "in_region", "?r"), ("?r", "r_name", "?region")]).select("who", "nation", "region")


@query(f"WITH {_TRIPLES_SQL} SELECT DISTINCT s, p, o FROM triples WHERE contains(lower(o), 'tion/1') OR contains(lower(o), 'us') ORDER BY s, p, o LIMIT 20")
def graph_context(s, d):
    return graph.graph_context(_triples(s, d), ["tion/1", "US"])


# recall, policy and references


@query(f"WITH {T} SELECT event_id, name FROM traces ORDER BY event_id DESC LIMIT 100")
def last_n(s, d):
    return ses.last_n(_traces(s, d).select("event_id", "name"), "event_id")


@query(f"WITH {T} SELECT event_id, name FROM traces WHERE name <> 'error' AND name IN ('click', 'view', 'error')")
def apply_policy(s, d):
    return ses.apply_policy(_traces(s, d), ("Error",), ("click", "VIEW", "error")).select("event_id", "name")


_FIELDS_SQL = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, {_FIELDS_SQL} AS w FROM conversations),
u AS (SELECT conv_id, turn, word, min(i) AS i FROM (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) WHERE strlen(word) > 2 AND word NOT IN {ses.STOP_WORDS} GROUP BY ALL),
k AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 5) GROUP BY ALL)
SELECT conv_id AS session_id, turn, coalesce(words, '') AS words FROM conversations LEFT JOIN k USING (conv_id, turn)""")
def keywords(s, d):
    return _messages(s, d).select("session_id", "turn", F.array_join(ses.keywords(F.coalesce("content", F.lit(""))), " ").alias("words"))


@query(f"""SELECT conv_id AS session_id, turn, CASE WHEN len({_FIELDS_SQL}) > 10 THEN 'hybrid' WHEN regexp_matches(lower(text), '{"|".join(ses.ABSTRACT)}') THEN 'vector' ELSE 'lexical' END AS mode FROM conversations""")
def route(s, d):
    return _messages(s, d).select("session_id", "turn", ses.route(F.col("content")).alias("mode"))


@query(f"""WITH f AS ({ORACLES["bm25_search"].replace("LIMIT 10", "LIMIT 50")}), r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM f),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3)
SELECT id, round(0.7 * coalesce(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT v FROM q)), 0) + 0.3 / r, 4) AS score FROM r LEFT JOIN embeddings e ON e.vec_id = r.id ORDER BY score DESC, id LIMIT 20""")
def hybrid_recall(s, d):
    first = search.bm25_search(_docs(s, d), "doc_id", "text", "thea inge", 50).withColumnRenamed("doc_id", "id")
    v = _vectors(s, d)
    return search.hybrid_recall(first, v, v.where("id = 3").select(F.col("vec").alias("q")), 20)


@query(f"""WITH {M}, {MEM}, h AS (SELECT content, round(least(1.0, ((length(content) - length(replace(lower(content), 'inge', ''))) / 4.0) / (floor(strlen(lower(content)) / 100) + 1)), 4) AS score
FROM messages WHERE contains(lower(content), 'inge') ORDER BY session_id DESC, turn DESC LIMIT 20)
SELECT CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview, score::DOUBLE AS score FROM h
UNION ALL SELECT '[Memory] ' || CASE WHEN length(memory) > 190 THEN substr(memory, 1, 190) || '...' ELSE memory END, 0.5 FROM memories WHERE user_id = 3 AND contains(lower(memory), 'inge')""")
def search_with_memory(s, d):
    return search.search_with_memory(_messages(s, d), src.read_memories(s, d).where("user_id = 3"), "inge", 20)


@query("SELECT vec_id, '[' || list_aggregate(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), 'string_agg', ',') || ']' AS text, len(embedding)::INTEGER AS n FROM embeddings")
def vec_format(s, d):
    e = src.load(s, d, "embeddings").select("vec_id", "embedding", search.vec_format(F.col("embedding")).alias("text"))
    # null components are left out of the text, and a vector without others has none
    n = F.coalesce(F.size(search.vec_parse(F.col("text"))), F.lit(0)) + F.size(F.filter("embedding", lambda x: x.isNull()))
    return e.select("vec_id", "text", F.when(F.col("embedding").isNotNull(), n).alias("n"))


@query(f"""WITH {C} SELECT identifier, coalesce(r_name, 'unknown') AS registry_name, CASE WHEN r_name IS NULL THEN 'unknown' WHEN r_regionkey = 0 THEN 'high' ELSE 'low' END AS trust
FROM catalog LEFT JOIN region ON r_regionkey = version % 7""")
def attach_trust(s, d):
    known = src.load(s, d, "region").select(F.col("r_regionkey").alias("registry"), F.col("r_name").alias("registry_name"), F.when(F.col("r_regionkey") == 0, "high").otherwise("low").alias("trust"))
    return cat.attach_trust(_catalog(s, d).withColumn("registry", F.col("version") % 7), known).select("identifier", "registry_name", "trust")


@query(f"""WITH {C} SELECT identifier, 0 AS part, concat_ws(' ', display_name, description, array_to_string(tags, ' '), array_to_string(capabilities, ' ')) AS text FROM catalog
UNION ALL SELECT identifier, 1, concat('find ', display_name) FROM catalog WHERE version % 2 = 0""")
def embed_text(s, d):
    some = F.when(F.col("version") % 2 == 0, F.array(F.concat(F.lit("find "), "display_name")))
    return cat.embed_text(_catalog(s, d).withColumn("queries", some))


_REF_SQL = " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS kind, unnest(regexp_extract_all(html, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS ref FROM pages" for k, p in web.REFERENCES.items() if k != "srcset"
)
_SRCSET = web.REFERENCES["srcset"].replace("'", "''")


@query(f"""SELECT DISTINCT * FROM ({_REF_SQL} UNION ALL SELECT page_id, 'srcset', regexp_extract(c, '^\\s*(\\S+)', 1)
FROM (SELECT page_id, unnest(string_split(x, ',')) AS c FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_SRCSET}', 1)) AS x FROM pages))) WHERE ref <> ''""")
def all_refs(s, d):
    return web.all_refs(_pages(s, d))


_MIME_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.MIME.items())


@query(f"""SELECT CASE lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.([A-Za-z0-9]+)$', 1)) {_MIME_CASES} ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM pages GROUP BY 1""")
def mime_counter(s, d):
    return web.mime_counter(_pages(s, d))


@query("""SELECT DISTINCT url, CASE WHEN bool_or(page_id % 13 <> 0) AND bool_or(page_id % 11 <> 0) THEN 'both' WHEN bool_or(page_id % 13 <> 0) THEN 'old' ELSE 'new' END AS side
FROM pages WHERE page_id % 13 <> 0 OR page_id % 11 <> 0 GROUP BY url""")
def changed_keys(s, d):
    p = _pages(s, d)
    return web.changed_keys(p.where("page_id % 13 <> 0"), p.where("page_id % 11 <> 0"), "url")


@query("""WITH a AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS f, ['en', 'about', 'index.html'] AS t FROM pages),
b AS (SELECT page_id, CASE WHEN len(f) > 0 AND contains(f[-1], '.') THEN f[1 : len(f) - 1] ELSE f END AS f, t FROM a),
c AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(f), len(t)) + 1), lambda i: f[i] IS DISTINCT FROM t[i])), len(f) + 1) - 1 AS n FROM b)
SELECT page_id, array_to_string(list_concat(list_transform(range(len(f) - n), lambda i: '..'), t[n + 1 :]), '/') AS path FROM c""")
def rel_path(s, d):
    return _pages(s, d).select("page_id", web.rel_path(web._part(F.col("url"), 3), F.lit("en/about/index.html")).alias("path"))
