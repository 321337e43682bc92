"""Sources and sinks on small folders, streams against their batch rules, and rules of jobs and plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from siltspark.functions import plugins
from siltspark.operators import assets, bundles, catalog, corpus, facts
from siltspark.plans import jobs
from siltspark.sources import tables
from siltspark.streaming import streams


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_read_docs(spark, tmp_path):
    for name in ("a.md", "sub/b.txt", "sub/c.png", "d.JSON"):
        write(tmp_path / name, f"text of {name} é")
    got = {(r.title, r.tags[0], r.text) for r in tables.read_docs(spark, str(tmp_path)).collect()}
    assert got == {("a", "md", "text of a.md é"), ("b", "txt", "text of sub/b.txt é")}


def test_bundle_round_trip_links_and_rejects(spark, tmp_path):
    write(tmp_path / "in/tables/orders.md", "---\ntype: table\ntitle: Orders\ntags: [a, b]\n---\nsee [c](customer.md), [r](../refs/r.md), [x](../none.md)")
    write(tmp_path / "in/tables/customer.md", "no front matter")
    write(tmp_path / "in/refs/r.md", "---\ntype: ref\n---\n[o](../tables/orders.md) [o](../tables/orders.md) [w](http://e.com/)")
    write(tmp_path / "in/bad.md", "---\ntype: ref\nnever closed")
    write(tmp_path / "in/index.md", "x")
    concepts, rejects = tables.read_bundle(spark, str(tmp_path / "in"))
    got = {r.id: (r.type, r.title, r.tags) for r in concepts.collect()}
    assert got == {"tables/orders": ("table", "Orders", ["a", "b"]), "tables/customer": ("concept", "", []), "refs/r": ("ref", "", [])}
    assert [r.path.rsplit("/", 1)[1] for r in rejects.collect()] == ["bad.md"]
    links = {(r.source, r.target, r.found) for r in bundles.resolve_concept_links(concepts).collect()}
    assert links == {("tables/orders", "tables/customer", True), ("tables/orders", "refs/r", True), ("tables/orders", "none", False), ("refs/r", "tables/orders", True)}
    tables.write_bundle(concepts, str(tmp_path / "out"))
    index = {r.type: r.ids for r in spark.read.json(str(tmp_path / "out/index")).collect()}
    assert index == {"table": ["tables/orders"], "concept": ["tables/customer"], "ref": ["refs/r"]}
    assert "title: Orders" in [r.value for r in spark.read.text(str(tmp_path / "out/concepts/type=table")).collect()]


def test_bundle_entry_of_no_concepts(spark):
    row = bundles.bundle_entry(spark.createDataFrame([], "id string, type string"), "none").first()
    assert row.concept_count == 0 and row.concept_types == []


def test_describe_tables(spark):
    t = {"a": spark.createDataFrame([], "k long, b_id int"), "b": spark.createDataFrame([], "id int")}
    got = {r.id: r.body for r in bundles.describe_tables(spark, t, {("a", "b_id"): "b"}).collect()}
    assert got["tables/a"] == "# Columns\n- k: bigint\n- b_id: int\n\n# Links\n- b_id -> [b](b.md)" and got["tables/b"] == "# Columns\n- id: int"


def test_catalog_files(spark, tmp_path):
    write(tmp_path / "c.json", json.dumps({"host": "h", "specVersion": "1", "entries": [{"identifier": "urn:air:a.com:x", "type": "t"}, {"identifier": "urn:air:b.com:y", "type": "u"}]}))
    entries = tables.read_catalog(spark, str(tmp_path / "c.json"))
    assert {(r.specVersion, r.identifier) for r in entries.collect()} == {("1", "urn:air:a.com:x"), ("1", "urn:air:b.com:y")}
    tables.write_catalog(entries, str(tmp_path / "out"))
    assert {r.publisher: r.type for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a.com": "t", "b.com": "u"}


def test_csv_to_triples(spark, tmp_path):
    write(tmp_path / "n.csv", "id,name,size\n1,a,2\n2,b,x\n3,c,\n4,d\n")
    triples, errors = tables.read_csv_mapped(spark, str(tmp_path / "n.csv"), "id int, name string, size int", "id")
    assert {(r.s, r.p, r.o) for r in triples.collect()} == {("1", "name", "a"), ("1", "size", "2"), ("3", "name", "c"), ("3", "size", None)}
    assert [r._bad for r in errors.collect()] == ["2,b,x", "4,d"]


def test_change_log(spark, tmp_path):
    write(tmp_path / "log.md", "# Log\n- Lost: a.md\n## 2024-01-02\n- Added: b.md (new one)\n- Updated: c.md\nwords\n## 2024-01-03\n- Removed: b.md\n")
    got = [(r.date, r.action, r.path, r.reason) for r in tables.read_change_log(spark, str(tmp_path / "log.md")).collect()]
    assert got == [(None, "Lost", "a.md", ""), ("2024-01-02", "Added", "b.md", "new one"), ("2024-01-02", "Updated", "c.md", ""), ("2024-01-03", "Removed", "b.md", "")]


def test_archive_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("A", f"u{i:03}", f"t{i}") for i in range(50)], "ns string, url string, text string")
    tables.write_archive(rows, str(tmp_path / "a"), 3)
    assert [r.text for r in tables.archive_get(spark, str(tmp_path / "a"), "A", "u007").collect()] == ["t7"]
    assert tables.archive_get(spark, str(tmp_path / "a"), "B", "u007").count() == 0
    tables.write_snapshot(spark.createDataFrame([("u", "é")], "url string, html string"), str(tmp_path / "s"), "c1")
    row = spark.read.parquet(str(tmp_path / "s")).first()
    assert (row.size, row.crawl_id, row.content_hash[:4]) == (2, "c1", "md5:")


def test_ignored(spark):
    rules = ["*.log", "!keep.log", "/tmp/x", "build/", "# c", "a[0-9]?"]
    want = {"a/b/debug.log": True, "a/keep.log": False, "tmp/x": True, "/tmp/x": False, "q/tmp/x": False, "out/rebuild-1/z": True, "za1b": True, "plain": False, "": False, None: False}
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", assets.ignored(F.col("p"), rules).alias("i"))
    got = {r.p: r.i for r in df.collect()}
    assert got == want
    assert not df.select(assets.ignored(F.col("p"), []).alias("i")).where("i").count()


@pytest.mark.parametrize(
    "base, ref, want",
    [
        ("http://e.com/a/b.html", "c.png", "http://e.com/a/c.png"), ("http://e.com", "c.png", "http://e.com/c.png"), ("https://e.com/a/", "//f.com/x", "https://f.com/x"), ("http://e.com/a?q", "?z=1", "http://e.com/a?z=1"),
        ("http://e.com/a/b", "../../../x", "http://e.com/x"), ("http://e.com/", "data:x", None), ("http://e.com/", "#a", None), ("http://e.com/", " ", None), ("http://e.com/", "HTTP://F.com:80", "http://f.com/"),
    ],
)
def test_resolve_ref(spark, base, ref, want):
    assert spark.createDataFrame([(base, ref)], "b string, r string").select(corpus.resolve_ref(F.col("b"), F.col("r"))).first()[0] == want


def test_want_asset_and_suffixes(spark):
    rows = [("http://a.e.com/x.css", "http://e.com/", True), ("http://e.com:8080/x", "http://e.com/", True), ("http://e.com/x.PDF", "http://e.com/", False), ("ftp://e.com/x", "ftp://e.com/", False), (None, "http://e.com/", False), ("http://a.co.uk/", "http://b.co.uk/", False)]
    got = spark.createDataFrame(rows, "u string, s string, w boolean").select("w", assets.want_asset(F.col("u"), F.col("s"), suffixes=["co.uk"]).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_extract_assets_of_odd_pages(spark):
    html = "<IMG class=a SRC=x.png><script>var a</script><link rel=canonical href=/no><link href='m.css' rel='preload stylesheet'><source srcset='s.png 2x,'><object data=\"o.swf\"></object><style>@import 'i.css';</style>"
    got = assets.extract_assets(spark.createDataFrame([(1, "http://e.com/d/", html), (2, "http://e.com/", ""), (3, None, html), (4, "http://e.com/", None)], "page_id int, url string, html string")).collect()
    assert {(r.page_id, r.element, r.url.removeprefix("http://e.com/d/")) for r in got} == {
        (1, "img.src", "x.png"), (1, "link.href", "m.css"), (1, "srcset", "s.png"), (1, "object.data", "o.swf"), (1, "css.import", "i.css"),
    }


def test_promote_facts(spark):
    m = [(1, 1, 0, "user", "I prefer tea over coffee"), (1, 1, 1, "user", " i PREFER tea over coffee "), (1, 1, 2, "assistant", "I prefer tea over coffee"), (1, 1, 3, "user", "what do you prefer, tea or coffee"), (2, 1, 0, "user", "remember that we will go there"), (2, 1, 1, "user", None), (2, 1, 2, "user", "注意这个地址在城市的另外一边没有人知道它在哪里")]
    got = facts.promote_facts(spark.createDataFrame(m, "session_id int, user_id int, turn int, role string, content string")).collect()
    assert {(r.session_id, r.turn, r.kind) for r in got} == {(1, 0, "preference"), (2, 0, "decision"), (2, 2, "note")}


def test_coerce_params(spark):
    spec = [{"key": "n", "type": "number", "required": True}, {"key": "b", "type": "boolean"}, {"key": "s", "default": "d"}, {"key": "o", "type": "select", "options": ["x"]}]
    cases = ['{"n": 2.0, "b": true, "s": "t", "o": "x"}', '{"n": 2.5}', '{"b": true}', '{"n": "2"}', '{"n": 1, "b": "true"}', '{"n": 1, "s": 5}', '{"n": 1, "o": "y"}', '{"n": null}', "[1]", "no", "", None]
    good, bad = facts.coerce_params(spark.createDataFrame(list(enumerate(cases)), "id int, args string"), spec)
    assert {r.id: (r.n, r.b, r.s, r.o) for r in good.collect()} == {0: ("2", "true", "t", "x"), 1: ("2.5", "", "d", "")}
    no = "arguments are no object"
    assert {r.id: r.error for r in bad.collect()} == {2: "missing n", 3: "n expects number", 4: "b expects boolean", 5: "s expects string", 6: "o is no option", 7: "n expects number", 8: no, 9: no, 10: "missing n", 11: "missing n"}


def test_parse_patches_rejects(spark):
    rows = [(1, '{"has_issue": true, "patch": "p", "confidence": 3}'), (2, '{"has_issue": true}'), (3, '{"has_issue": false}'), (4, "{broken"), (5, None), (6, ""), (7, '{"has_issue": true, "patch": "p", "confidence": -1}')]
    good, bad = facts.parse_patches(spark.createDataFrame(rows, "id int, response string"))
    assert {r.id: r.confidence for r in good.collect()} == {1: 1.0, 7: 0.0}
    assert {r.id: r.reject for r in bad.collect()} == {2: "empty patch", 4: "no json", 5: "no json", 6: "no json"}


def test_valid_attestations_nulls(spark):
    schema = "manifest_id int, attestations array<struct<type: string, uri: string, valid_from: timestamp, valid_until: timestamp>>, expires_at timestamp"
    rows = [(1, None, None), (2, [], None), (3, [("t", None, None, None)], None), (4, [("t", "u", None, None)], None)]
    got = {r.manifest_id: (r.n_valid, r.valid) for r in catalog.valid_attestations(spark.createDataFrame(rows, schema), "2024-01-01").collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (0, False), 4: (1, True)}


def test_embedder_failures_are_null(spark):
    def fn(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "boom")], "id int, text string").coalesce(1)
    assert {r.id: r.vec for r in plugins.embed(df, "text", fn, batch=2).collect()} == {1: [2.0], 2: None, 3: [0.0], 4: None}
    unit = plugins.embed(df, "text").where("id = 1").first().vec
    assert abs(sum(x * x for x in unit) - 1) < 1e-6


def test_tool_trajectory(spark):
    df = spark.createDataFrame([(1, ["Read_File", "run"], ["file", "write"]), (2, [], [])], "case_id int, tools array<string>, expected_tools array<string>")
    got = {r.case_id: (r.tool_trajectory_match, r.passed) for r in plugins.score_metrics(df, {"tool_trajectory_match": 0.5}).collect()}
    assert got == {1: (0.5, True), 2: (1.0, True)}


def test_ingest_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, "user", f"m{k}") for k in range(30)]
    schema = "session_id int, turn int, role string, content string"
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.ingest_messages(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    want = {(s, t) for s in range(3) for t in sorted((k for k in range(30) if k % 3 == s), reverse=True)[:4]}
    assert {(r.session_id, r.turn) for r in streams.stored_messages(spark, str(tmp_path / "log"), 4).collect()} == want
    streams.compact_messages(spark, str(tmp_path / "log"), str(tmp_path / "log2"), 4)
    assert {(r.session_id, r.turn) for r in streams.stored_messages(spark, str(tmp_path / "log2"), 9).collect()} == want


def test_budget_stream(spark, tmp_path):
    # session 1: texts of 10 tokens a minute; session 2: one late message
    rows = [(1, 60 * k, "x" * 40) for k in range(12)] + [(2, 0, "x"), (2, 301, "x"), (2, 302, None)]
    df = spark.createDataFrame(rows, "session_id int, s long, content string").select("session_id", F.timestamp_seconds("s").alias("ts"), "content")
    for low, high in ((0, 240), (241, 10_000)):
        df.where(F.unix_seconds("ts").between(low, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.budget_stream(stream, most_tokens=50, trim=0.0, gap_s=300).writeStream.format("memory").queryName("budget").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.session_id, int(r.ts.timestamp()), r.tokens, r.n, r.reason) for r in spark.table("budget").collect())
    assert [g[0:1] + g[2:] for g in got] == [(1, 60, 6, "tokens"), (1, 60, 6, "tokens"), (2, 0, 2, "time")]


def streamed(spark, df, files, make, mode, name, folder):
    """What a stream over df's rows, one file after the other, gives in the end; its last row for each key in update mode."""
    for low, high in files:
        df.where(F.col("part").between(low, high)).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams_equal_batch_without_late_rows(spark, tmp_path):
    hours = 3600
    rows = [(k, "call" if k % 2 else "chat", 7 + k % 2, 600 * k, float(k), k % 3 != 0, k // 40) for k in range(120)]
    rows += [(900, "call", 7, 10, 1.0, False, 3), (901, "call", 7, 90 * hours, 1.0, True, 4)]  # a day late, and one that closes all windows
    df = spark.createDataFrame(rows, "event_id int, name string, user_id int, s long, duration_ms double, success boolean, part int").withColumns(
        {"ts": F.timestamp_seconds("s"), "error_count": F.when(F.col("success"), 0).otherwise(1), "quality": F.lit(0.9)}
    ).drop("s")
    files = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]
    on_time = df.where("event_id < 900")
    # windows: the late failure is dropped, the rest is what a batch gives
    make = lambda d: streams.failure_windows(d, "4 hours", late="1 hour", limit=4)
    got = streamed(spark, df, files, make, "append", "windows", tmp_path)
    assert sorted(map(tuple, got)) == sorted(map(tuple, make(on_time).collect())) and all(r.limited == (r.n >= 4) for r in got)
    # sessions: one gap of a day ends them; each user's newest events in order
    make = lambda d: streams.live_sessions(d, "3 hours", "1 hour", most=5)
    got = streamed(spark, df.where("event_id <> 900"), files, make, "append", "sessions", tmp_path)
    assert sorted(map(tuple, got)) == sorted(map(tuple, make(on_time).collect()))
    assert {(r.user_id, r.n): r.events for r in got} == {(7, 60): [110, 112, 114, 116, 118], (8, 60): [111, 113, 115, 117, 119]}
    # counters: the last update of each name is the batch's row
    got = {r.name: r for r in streamed(spark, df, files, streams.metric_stream, "update", "metrics", tmp_path)}
    assert {tuple(r) for r in got.values()} == {tuple(r) for r in streams.metric_stream(df).collect()}
    assert (got["call"].last_ms, got["call"].last_error, got["chat"].errors) == (1.0, "", 20)


def test_promotion_keeps_facts_once(spark, tmp_path):
    texts = [(1, "user", "I prefer green tea in the morning"), (1, "user", "I prefer green tea in the morning"), (2, "user", "I prefer green tea in the morning"), (1, "assistant", "I prefer black coffee every day"),
             (1, "user", "what do you prefer to drink today?"), (3, "user", "We decided to ship it on Friday"), (3, "user", "nothing of note was said here at all"), (3, "user", None)]
    df = spark.createDataFrame([(*t, 60 * k, k // 3) for k, t in enumerate(texts)], "session_id int, role string, content string, s long, part int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = streamed(spark, df, [(0, 0), (1, 1), (2, 2)], streams.promote_stream, "append", "promoted", tmp_path)
    assert sorted((r.session_id, r.kind) for r in got) == [(1, "preference"), (2, "preference"), (3, "decision")]


def test_web_corpus_files(spark, tmp_path):
    html = "<title>t</title><script>x</script><a href='/b'>b</a>" + "w" * 200
    pages = spark.createDataFrame([(1, "http://e.com/a", html), (2, "http://e.com/a#x", html), (3, "http://e.com/b", html), (4, "http://o.com/", html), (5, "http://e.com/c", "captcha"), (6, "http://e.com/d", None), (7, None, html)], "page_id int, url string, html string")
    built = jobs.build_web_corpus(pages, "e.com")
    assert [r.page_id for r in built["articles"].collect()] == [1]
    assert tuple(built["stats"].select("pages", "articles").first()) == (2, 1)
    jobs.write_web_corpus(built, str(tmp_path), "c1", 2)
    assert tables.archive_get(spark, str(tmp_path / "archive"), "A", "http://e.com/a").count() == 1
    assert spark.read.parquet(str(tmp_path / "snapshots")).count() == 2


def test_hybrid_recall_embeds_only_the_pool(spark):
    m = spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(["why tea is hot", "tea is why", "coffee", None])], "session_id int, turn int, role string, content string")
    none = spark.createDataFrame([], "memory_id string, memory string")
    got = jobs.recall(m, none, "why tea", 5).collect()
    assert {r.id for r in got} == {"1:0", "1:1"} and all(r.score > 0.15 for r in got)


def test_discovery_with_trust_and_meaning(spark):
    schema = "identifier string, display_name string, type string, url string, description string, tags array<string>, capabilities array<string>, version int"
    one = spark.createDataFrame([("urn:air:a.com:x", "tea shop", "t", "u", "d", ["k"], ["c"], 1)], schema)
    sem = spark.createDataFrame([("urn:air:a.com:x", 1.0), ("urn:air:b.com:y", 0.8)], "id string, score double")
    known = spark.createDataFrame([("r", "R", "high")], "registry string, registry_name string, trust string")
    got = {r.identifier: (r.score, r.trust) for r in jobs.catalog_discovery({"r": one}, "tea", semantic=sem, trust=known)["results"].collect()}
    assert got == {"urn:air:a.com:x": (0.7, "high"), "urn:air:b.com:y": (0.4, "unknown")}


def test_links_of_hidden_and_relative_elements(spark):
    html = """<a href="x">1</a><A HREF='../y#f'>2</a><area href=/z><iframe src="//f.com/"></iframe><a hidden href="/h1">h</a><a style="display: none" href="/h2">h</a><a aria-hidden="true" href="/h3"></a>
    <a style="opacity:0.5" href="/seen"></a><a href="#t"></a><a href="mailto:a@b.c"></a><a href="javascript:x()"></a><a data-hidden-x="1" href="/z"></a><article href="/no"></article>"""
    got = {r.target for r in corpus.extract_links(spark.createDataFrame([(1, "http://e.com/d/p", html), (2, "http://e.com/", None), (3, None, html)], "page_id int, url string, html string")).where("page_id < 3").collect()}
    assert got == {"http://e.com/d/x", "http://e.com/y", "http://e.com/z", "http://f.com/", "http://e.com/seen"}


def test_robots_groups(spark):
    urls = spark.createDataFrame([(1, "a", "/x"), (2, "b", "/x"), (3, "c", "/x")], "page_id int, host string, path string")
    rules = spark.createDataFrame([("a", "*", "/", True), ("a", "Bot", "/x", False), ("b", "*", "/", False), ("b", "other", "/x", True)], "host string, agent string, rule_path string, allow boolean")
    assert {r.page_id: r.allowed for r in corpus.robots_allowed(urls, rules, "bot").collect()} == {1: False, 2: False, 3: True}


def test_block_headers(spark):
    rows = [(200, "fine", {"CF-Ray": "1"}, "challenge"), (503, "x", {}, "unavailable"), (503, "x", {"cf-ray": "1"}, "challenge"), (200, "fine", None, None), (403, "", {"cf-ray": "1"}, "forbidden")]
    df = spark.createDataFrame(rows, "s int, h string, m map<string, string>, w string")
    assert [r.g for r in df.select(corpus.block_reason(F.col("s"), F.col("h"), F.col("m")).alias("g")).collect()] == [r[3] for r in rows]


def test_expired_manifest(spark):
    m = spark.createDataFrame([(1, "spiffe", ["a"], True, "2023-01-01"), (2, "spiffe", ["a"], True, None)], "manifest_id int, identity_type string, attestations array<string>, trusted boolean, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    assert {r.manifest_id: r.violations for r in catalog.compliance(m, 0.5, ["spiffe"], ["a"], "2024-01-01").collect()} == {1: "EXPIRED_MANIFEST", 2: ""}


def test_eval_files(spark, tmp_path):
    write(tmp_path / "cases/a.json", json.dumps([{"case_id": "1", "response": "Some text", "expected_pattern": "TEXT"}, {"case_id": "2", "response": "none"}]))
    cases = tables.read_eval(spark, str(tmp_path / "cases"))
    tables.write_eval(plugins.score_metrics(cases, {"response_contains_pattern": 1.0}), str(tmp_path / "out"))
    assert {r.case_id: r.passed for r in spark.read.json(str(tmp_path / "out")).collect()} == {"1": True, "2": True}


@pytest.mark.parametrize("html, want", [("a" * 100 + " Please Verify\n\n" + "b" * 100, "a" * 59 + " Please Verify " + "b" * 58), ("x blocked", "x blocked"), ("fine", ""), (None, "")])
def test_block_snippet(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(corpus.block_snippet(F.col("h"))).first()[0] == want
