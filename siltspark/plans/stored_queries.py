"""Registered queries of stored indexes, recall for tables of queries, pattern scans, archives and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltspark.operators import catalog as cat
from siltspark.operators import corpus as web
from siltspark.operators import longkeys, patterns, postings, sessions, vectors
from siltspark.plans import jobs
from siltspark.plans.registry import query
from siltspark.sources import items
from siltspark.sources import tables as src
from siltspark.sources.ranged import work_dir

#: What is asked: two letter words of each benchmark item, and the items' whole texts, whose ids are negative.
_ASKED_SQL = """asked AS (
  SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[A-Za-z]{4,}')[1:2], ' ') AS text FROM benchmark
  UNION ALL SELECT -1 - item_id, text FROM benchmark)"""


def _asked(s, d):
    b = src.load(s, d, "benchmark")
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 2), " ")
    return b.select(F.col("item_id").alias("query_id"), short.alias("text")).unionByName(b.select((-1 - F.col("item_id")).alias("query_id"), "text"))


_MANY_SQL = rf"""{_ASKED_SQL},
doc AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM doc),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM doc) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
word AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS w FROM asked),
n AS (SELECT query_id, count(*) AS n_words FROM word GROUP BY 1),
fit AS (SELECT w, term, df FROM (SELECT DISTINCT w FROM word) JOIN df ON starts_with(term, w)),
live AS (SELECT query_id FROM word GROUP BY query_id HAVING bool_and(w IN (SELECT w FROM fit))),
qt AS (SELECT query_id, term, df, list(w) AS ws FROM word JOIN fit USING (w) WHERE query_id IN (FROM live) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score,
       len(list_distinct(flatten(list(ws)))) AS hit FROM qt JOIN tf USING (term), st GROUP BY query_id, doc_id),
many AS (SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, doc_id) AS rank
         FROM sc JOIN n USING (query_id) WHERE hit = n_words)"""


@query(f"WITH {_MANY_SQL} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM many WHERE rank <= 20")
def stored_search(s, d):
    """The benchmark's queries against a stored index of all documents, which has grown by a second segment."""
    path = f"{work_dir(s)}/index"
    docs = src.load(s, d, "documents")
    postings.add_documents(docs.where("doc_id % 4 <> 1"), path, "doc_id", "text")
    postings.add_documents(docs.where("doc_id % 4 = 1"), path, "doc_id", "text")
    return postings.search_many(s, path, _asked(s, d), 20).select("query_id", F.col("key").alias("doc_id"), "score", "rank")


_LETTERS = "etaoinshr"


def _letters(texts):
    """An embedder that SQL can follow: counts of letters."""
    return [[float(t.count(c)) for c in _LETTERS] for t in texts]


_COUNTS = lambda c: "[" + ", ".join(f"CAST(length({c}) - length(replace({c}, '{x}', '')) AS DOUBLE)" for x in _LETTERS) + "]"
_SHORT = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"
_MODE = (
    r"CASE WHEN len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda t: t <> '')) > 10 THEN 'hybrid' WHEN "
    + " OR ".join(f"contains(lower(text), '{a}')" for a in sessions.ABSTRACT)
    + " THEN 'vector' ELSE 'lexical' END"
)


@query(rf"""WITH {_MANY_SQL},
near AS (SELECT query_id, doc_id,
  round(least(1.0, (length(d.text) - length(replace(lower(d.text), lower(asked.text), ''))) / length(asked.text) / (floor(strlen(lower(d.text)) / 100) + 1)), 4) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS r
  FROM asked JOIN documents d ON contains(lower(d.text), lower(asked.text)) WHERE trim(asked.text) <> ''),
u AS (SELECT query_id, doc_id::VARCHAR || ':0' AS id, score, 0 AS source FROM many WHERE rank <= 50
  UNION ALL SELECT query_id, doc_id::VARCHAR || ':0', score, 1 FROM near WHERE r <= 50),
f AS (SELECT query_id, id, arg_min(score, source) AS score, min(source) AS source FROM u GROUP BY ALL),
mode AS (SELECT query_id, text, {_MODE} AS mode FROM asked),
pool AS (SELECT query_id, id, score, mode, text FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, score DESC, id) AS r FROM f JOIN mode USING (query_id))
  WHERE r <= CASE WHEN mode = 'lexical' THEN 10 ELSE 50 END),
again AS (SELECT query_id, id, {_COUNTS('p.text')} AS q, {_COUNTS('d.text')} AS v, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r
  FROM pool p JOIN documents d ON d.doc_id::VARCHAR || ':0' = id WHERE mode <> 'lexical'),
cosine AS (SELECT query_id, id, r, CASE WHEN list_dot_product(q, q) > 0 AND list_dot_product(v, v) > 0
  THEN list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))) ELSE 0 END AS c FROM again),
scored AS (SELECT query_id, id, round(0.7 * c + 0.3 / r, 4) AS score FROM cosine),
found AS (SELECT query_id, id, score FROM pool WHERE mode = 'lexical' UNION ALL SELECT query_id, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored) WHERE r <= 10)
SELECT query_id, id, {_SHORT('text', 200)} AS preview, score::DOUBLE AS score FROM found JOIN documents ON doc_id::VARCHAR || ':0' = id
UNION ALL SELECT query_id, item_id::VARCHAR, '[Memory] ' || {_SHORT('b.text', 190)}, 0.5
FROM asked JOIN benchmark b ON contains(lower(b.text), lower(asked.text)) WHERE trim(asked.text) <> ''""")
def recall_all(s, d):
    """Two queries of every benchmark item over all documents as messages, and the items as memories."""
    told = src.load(s, d, "documents").select(F.col("doc_id").alias("session_id"), F.lit(0).alias("user_id"), F.lit(0).alias("turn"), F.col("text").alias("content"))
    memories = src.load(s, d, "benchmark").select(F.col("item_id").alias("memory_id"), F.col("text").alias("memory"))
    return jobs.recall_all(told, _asked(s, d), memories, 10, _letters)


#: Commands made of calls: some whose text is risky, told apart by the event's id.
_COMMANDS_SQL = r"""commands AS (SELECT event_id AS doc_id, concat(CASE event_id % 13 WHEN 0 THEN 'sudo RM -rf /' WHEN 1 THEN 'C:\Temp\run.exe ' WHEN 2 THEN '/usr/tmp/x chmod 777 '
 WHEN 3 THEN 'rm /home/.config/' WHEN 4 THEN 'curl -s -F a@b ' WHEN 5 THEN 'curl.*-F.*@ ' WHEN 6 THEN 'ls /tmp/ ' ELSE 'echo ' END, event_type, ' ', CAST(user_id AS VARCHAR)) AS text FROM events)"""


def _commands(s, d):
    e = src.load(s, d, "events")
    k = F.col("event_id") % 13
    said = {0: "sudo RM -rf /", 1: "C:\\Temp\\run.exe ", 2: "/usr/tmp/x chmod 777 ", 3: "rm /home/.config/", 4: "curl -s -F a@b ", 5: "curl.*-F.*@ ", 6: "ls /tmp/ "}
    first = F.lit("echo ")
    for n, t in said.items():
        first = F.when(k == n, t).otherwise(first)
    return e.select(F.col("event_id").alias("doc_id"), F.concat(first, "event_type", F.lit(" "), F.col("user_id").cast("string")).alias("text"))


_QUOTED = lambda t: t.replace("'", "''")
_RULES_SQL = ", ".join([f"('{_QUOTED(p)}', '{w}')" for p, w in patterns.RISKS] + [f"('{_QUOTED(p)}', 'needs approval')" for p in patterns.DANGEROUS])


@query(rf"""WITH {_COMMANDS_SQL}, p(pattern, risk) AS (VALUES {_RULES_SQL})
SELECT doc_id, pattern, risk FROM commands JOIN p ON contains(lower(text), lower(pattern))
UNION ALL SELECT doc_id, '/tmp/', 'binary in temporary directory' FROM commands WHERE contains(regexp_extract(text, '^\s*(\S+)', 1), '/tmp/') OR contains(regexp_extract(text, '^\s*(\S+)', 1), '\Temp\')
UNION ALL SELECT doc_id, '/.', 'deletion of hidden files' FROM commands WHERE contains(text, '/.') AND contains(lower(text), 'rm ')""")
def scan_known_risks(s, d):
    """Commands made of all events against the known rules."""
    return patterns.scan_commands(_commands(s, d))


@query(r"""WITH p(pattern, risk, regex) AS (VALUES ('Rights Reserved', 'license', false), ('password', 'secret', false), ('AKIA', 'secret', false), ('akia[0-9a-z]+', 'key', true), ('(token|secret)\s*[:=]', 'key', true))
SELECT doc_id, pattern, risk FROM documents JOIN p ON CASE WHEN regex THEN regexp_matches(text, pattern, 'i') ELSE contains(lower(text), lower(pattern)) END
UNION ALL SELECT doc_id, item_id::VARCHAR, 'benchmark' FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def scan_texts(s, d):
    """All documents against a user's rules, and against the texts of all benchmark items."""
    rules = s.createDataFrame(
        [("Rights Reserved", "license", False), ("password", "secret", False), ("AKIA", "secret", False), ("akia[0-9a-z]+", "key", True), (r"(token|secret)\s*[:=]", "key", True)],
        "pattern string, risk string, regex boolean",
    )
    docs, items = src.load(s, d, "documents"), src.load(s, d, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    held = patterns.find_patterns(docs, ["doc_id"], "text", items)
    return patterns.scan_commands(docs, rules).unionAll(held.select("doc_id", F.col("pattern_id").cast("string"), F.lit("benchmark")))


@query(r"""WITH host AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url FROM pages), keys AS (SELECT min(url) AS url FROM host GROUP BY host UNION SELECT max(url) FROM host GROUP BY host)
SELECT 'A' AS ns, url, page_id, md5(html) AS hash FROM pages WHERE url IN (FROM keys)""")
def archive_look_up(s, d):
    """The first and last page of every host, looked up in an archive of all pages."""
    pages = src.load(s, d, "pages")
    path = work_dir(s)
    src.write_archive(pages.select(F.lit("A").alias("ns"), "url", "page_id", "html"), path)
    ends = pages.groupBy(web.host(F.col("url"))).agg(F.array(F.min("url"), F.max("url")).alias("ends"))
    keys = ends.select(F.lit("A").alias("ns"), F.explode("ends").alias("url"))
    return src.archive_look_up(s, path, keys).select("ns", "url", "page_id", F.md5("html").alias("hash"))


_CHAIN_SQL = f"""{src.TRACES_SQL}, signed AS (SELECT event_id, name, ts, sha256(concat(name, '|', event_id)) AS signature FROM traces),
linked AS (SELECT *, lag(signature) OVER (PARTITION BY name ORDER BY ts, event_id) AS previous_hash FROM signed),
kept AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 5 THEN 'changed' ELSE signature END AS signature) FROM linked WHERE event_id % 89 <> 3)"""


@query(f"""WITH {_CHAIN_SQL}, v AS (SELECT name, event_id, ts, previous_hash IS NOT DISTINCT FROM lag(signature) OVER (PARTITION BY name ORDER BY ts, event_id) AS unbroken FROM kept)
SELECT name, count(*) AS records, count(*) FILTER (WHERE NOT unbroken) AS broken, (list(event_id ORDER BY ts, event_id) FILTER (WHERE NOT unbroken))[1] AS first_break FROM v GROUP BY name""")
def chain_breaks(s, d):
    """Chains of all events by name after some records were lost and some signatures changed."""
    linked = longkeys.sign_chain(src.read_traces(s, d))
    changed = F.when(F.col("event_id") % 97 == 5, "changed").otherwise(F.col("signature"))
    return longkeys.first_breaks(linked.where("event_id % 89 <> 3").withColumn("signature", changed))


@query("""WITH m AS (SELECT conv_id, turn, length(text) // 4 AS t, conv_id % 3 AS shop FROM conversations)
SELECT conv_id, turn, CAST(sum(t) OVER w AS BIGINT) AS tokens, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY shop ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)""")
def running_tokens(s, d):
    """Running tokens and messages over three long keys of all conversations."""
    c = src.load(s, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 3).alias("shop"), F.floor(F.char_length("text") / 4).alias("t"), F.lit(1).alias("one"))
    return longkeys.running_sums(c, ["shop"], ["conv_id", "turn"], {"tokens": "t", "n": "one"}).select("conv_id", "turn", "tokens", "n")


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (SELECT DISTINCT host FROM u), (VALUES ('/en/', false, '^/en/'), ('/', true, '^/'), ('/*/1', true, '^/.*/1'), ('/*0$', false, '^/.*0$'), ('/fr/', false, '^/fr/'), ('/fr/', true, '^/fr/')) AS t(p, a, x))
SELECT page_id, coalesce(arg_max(a, length(p) * 2 + a::INT), true) AS allowed FROM u LEFT JOIN r ON u.host = r.host AND regexp_matches(path, x) GROUP BY page_id""")
def robots_patterns(s, d):
    """Robots rules with stars and ends for every host of the pages."""
    u = src.load(s, d, "pages").select("page_id", web.host(F.col("url")).alias("host"), web._part(F.col("url"), 3).alias("path"))
    known = (("/en/", False), ("/", True), ("/*/1", True), ("/*0$", False), ("/fr/", False), ("/fr/", True))
    rules = F.array(*[F.struct(F.lit(p).alias("rule_path"), F.lit(a).alias("allow")) for p, a in known])
    return web.robots_allowed(u, u.select("host").distinct().select("host", F.inline(rules)))


@query(f"""WITH {src.CATALOG_SQL} SELECT DISTINCT regexp_extract(identifier, '^urn:[^:]+:([^:]+):.', 1) AS value FROM catalog""")
def distinct_publishers(s, d):
    return cat.distinct_values(src.read_catalog_entries(s, d), "publisher")


@query("""WITH n AS (SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
p AS (SELECT session_id, i, concat(CASE role WHEN 'user' THEN '### 👤 User' || chr(10) || chr(10) WHEN 'assistant' THEN '### 🤖 Assistant' || chr(10) || chr(10) WHEN 'tool' THEN '#### 🔧 Tool Result' || chr(10) || chr(10) || '```' || chr(10)
  ELSE '### ' || role || chr(10) || chr(10) END, text, CASE WHEN role = 'tool' THEN chr(10) || '```' ELSE '' END, chr(10), chr(10)) AS piece FROM n)
SELECT session_id || '.md' AS path, md5(concat('# Session: ', session_id[1:8], chr(10), chr(10), '**Exported**: 2024-02-01', chr(10), chr(10), '---', chr(10), chr(10), string_agg(piece, '' ORDER BY i), chr(10), '---', chr(10), '*', count(*), ' message turns exported*', chr(10))) AS hash
FROM p GROUP BY session_id""")
def exported_sessions(s, d):
    """Every session written as a markdown file, and the files read again."""
    folder = work_dir(s)
    items.write_sessions(src.read_messages(s, d), folder, "markdown", "2024-02-01")
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("path"), F.md5("content").alias("hash"))


@query("""WITH o AS (SELECT url, md5(html) AS h, 'e' || page_id AS etag FROM pages WHERE page_id % 13 <> 0),
n AS (SELECT url, md5(CASE WHEN page_id % 7 = 0 THEN concat(html, '<!-- v2 -->') ELSE html END) AS h, CASE WHEN page_id % 14 = 0 THEN 'e' || page_id ELSE '' END AS etag, CASE WHEN page_id % 21 = 0 THEN 304 ELSE 200 END AS code FROM pages WHERE page_id % 11 <> 0)
SELECT url, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN code = 304 OR (n.etag <> '' AND o.etag = n.etag) OR o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status,
 CASE WHEN o.h IS NULL THEN 'not cached' WHEN n.h IS NULL THEN 'gone' WHEN code = 304 THEN 'not modified' WHEN n.etag <> '' AND o.etag = n.etag THEN 'etag' WHEN o.h = n.h THEN 'hash' ELSE 'differs' END AS reason FROM o FULL JOIN n USING (url)""")
def diff_crawls(s, d):
    """Two of three stored crawls of the pages, told apart by answers, etags and hashes."""
    pages, path = src.load(s, d, "pages"), work_dir(s)
    k = F.col("page_id")
    etag = F.concat(F.lit("e"), k.cast("string"))
    src.write_snapshot(pages.where(k % 13 != 0).withColumn("etag", etag), path, "one")
    src.write_snapshot(pages.where("false"), path, "two")
    new = pages.where(k % 11 != 0).withColumns({"etag": F.when(k % 14 == 0, etag).otherwise(""), "status": F.when(k % 21 == 0, 304).otherwise(200)})
    src.write_snapshot(new.withColumn("html", F.when(k % 7 == 0, F.concat("html", F.lit("<!-- v2 -->"))).otherwise(F.col("html"))), path, "three")
    return src.diff_crawls(s, path, "one", "three")


@query("""WITH v AS (SELECT vec_id, vec_id // 2 AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS q_id, b.item AS b_id, max(round(list_cosine_similarity(q.v, b.v), 12)) AS c FROM v q JOIN v b ON b.item <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT q_id, b_id, round(c, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, b_id) AS rank FROM s) WHERE rank <= 10""")
def nearest_items(s, d):
    """The ten nearest of all items, each of two vectors, for every fiftieth vector."""
    e = src.load(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.nearest(e.where("id % 50 = 0"), e.withColumn("id", F.expr("id div 2")), 10).withColumn("score", F.round("score", 4))


@query("""WITH d AS (SELECT md5(concat(length('=' || url), '=' || url, CASE WHEN html IS NULL THEN '1-' ELSE concat(length('=' || html), '=' || html) END)) AS d FROM pages),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(d, 1, 15) AS HUGEINT)) AS a, sum(CAST('0x' || substr(d, 16, 15) AS HUGEINT)) AS b FROM d) SELECT n, md5(concat_ws(':', n, CAST(a AS HUGEINT), CAST(b AS HUGEINT))) AS digest FROM s""")
def multiset_digest(s, d):
    """The digest of all pages' urls and contents."""
    return web.multiset_digest(src.load(s, d, "pages"), ["url", "html"])


@query("""SELECT 'nation' AS kind, count(*) AS rows, 2 * count(*) AS triples, 0::BIGINT AS errors FROM nation
UNION ALL SELECT 'supplier', count(*), count(s_nationkey) + count(s_name) + count(s_acctbal), 0 FROM supplier UNION ALL SELECT 'customer', count(*), count(c_nationkey) + count(c_name), 0 FROM customer""")
def import_tables(s, d):
    """What importing three tables as triples read and made."""
    t = lambda name: src.load(s, d, name)
    tables = {
        "nation": (t("nation"), "n_nationkey", {"n_regionkey": ("in_region", "region")}, ["n_name"]),
        "supplier": (t("supplier"), "s_suppkey", {"s_nationkey": ("in_nation", "nation")}, ["s_name", "s_acctbal"]),
        "customer": (t("customer"), "c_custkey", {"c_nationkey": ("in_nation", "nation")}, ["c_name"]),
    }
    return jobs.import_tables(tables, work_dir(s))
