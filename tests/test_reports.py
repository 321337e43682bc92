"""Reports, registrations and web keys on small frames; their queries run against SQL in test_queries."""

from pyspark.sql import functions as F

from siltspark.operators import catalog, corpus, reports, sessions


def test_page_keys_of_index_pages_and_other_hosts(spark):
    key = lambda url, seed=None: spark.createDataFrame([(url,)], "u string").select(corpus.page_key(F.col("u"), F.lit(seed) if seed else None)).first()[0]
    assert key("http://a.b/x/INDEX.htm?q=1") == key("http://a.b/x/") == "x/index.html" and key("http://a.b/index.html?q=1") == "index.html"
    assert key("http://a.b/x?q=1", "A.b").startswith("x__q-") and key("http://C.b/x", "a.b") == "c.b/x.html" and key("http://a.b/x.y", "a.b") == "x.y"


def test_queries_of_urls_are_escaped(spark):
    urls = [("http://a.b/c?x=a b|c:<d>\"e\"*?\\", "http://a.b/c?x=a%20b%7Cc%3A%3Cd%3E%22e%22%2A%3F%5C"), ("http://a.b/c?", "http://a.b/c"), ("http://a.b/c?x=1&y=%20", "http://a.b/c?x=1&y=%20")]
    got = spark.createDataFrame(urls, "u string, want string").select(corpus.canonical_url(F.col("u")).alias("c"), "want").collect()
    assert [r.c for r in got] == [r.want for r in got]


def test_grep_leaves_out_excluded_paths(spark):
    paths = [None, "a.py", "x/.git/a", "node_modules/a/b", "a.tar.xz", "a.pyc", "vendors/a", "x/vendor", "tar", "my.git"]
    docs = spark.createDataFrame([(i, p, "no\nyes") for i, p in enumerate(paths)], "doc_id long, path string, text string")
    assert sorted(r.doc_id for r in corpus.grep(docs, "yes", path="path").collect()) == [0, 1, 6, 8, 9]
    assert corpus.grep(docs, "yes", path="path", excluded=()).count() == corpus.grep(docs, "yes").count() == len(paths)


def test_registration_rejects_what_is_there(spark):
    base = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 1), ("b", 2), (None, 1)], "id string, v int")
    got = {(r.id, r.v): r.accepted for r in catalog.register(base, new, "id", "v").collect()}
    assert got == {("a", 2): False, ("b", 1): True, ("b", 2): False, (None, 1): False}
    assert catalog.register(base.limit(0), new, "id", "v").where("accepted").count() == 2


def test_violations_have_severities(spark):
    rows = [(1, "spiffe", ["A"], True, "2030-01-01 00:00:00"), (2, "pgp", [], False, "2020-01-01 00:00:00")]
    m = spark.createDataFrame(rows, "manifest_id long, identity_type string, attestations array<string>, trusted boolean, expires_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
    got = sorted((r.manifest_id, r.violation, r.severity) for r in catalog.violations(m, 0.6, ["spiffe"], ["A"], "2024-01-01 00:00:00").collect())
    assert got == [(2, "EXPIRED_MANIFEST", "critical"), (2, "INVALID_IDENTITY_TYPE", "critical"), (2, "LOW_TRUST_SCORE", "high"), (2, "MISSING_CERTIFICATION", "high")]


def test_merged_text_is_cut_at_any_length(spark):
    for sizes in ([3, 0, 4], [8], [7, 1], [6, 1, 5], [5, 0, 1, 9], [20, 20]):
        parts = ["x" * n for n in sizes]
        m = spark.createDataFrame([(1, i, p, None if i else "t") for i, p in enumerate(parts)], "session_id long, turn int, content string, title string")
        for most in (1, 2, 3):
            whole = "\n\n".join(p for p in parts if p)
            want = whole if len(whole) <= most * 4 else whole[: most * 4] + "..."
            assert sessions.merge_text(m, most).first().merged == want
    m = spark.createDataFrame([(1, 0, "a", "T"), (1, 1, "b", None), (1, 2, "", "U"), (1, 3, None, "V")], "session_id long, turn int, content string, title string")
    assert sessions.merge_text(m, 100, title="title").first().merged == "## T\na\n\nb"


def test_cases_without_a_response_fail(spark):
    cases, responses = spark.createDataFrame([(1,), (2,)], "case_id long"), spark.createDataFrame([(1, "the end"), (3, "x")], "case_id long, response string")
    got = {r.case_id: r.passed for r in sessions.score_eval(sessions.with_responses(cases, responses), "the", 5).collect()}
    assert got == {1: True, 2: False}


def test_crawl_totals_and_look_ups_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, status int")
    assert set(reports.crawl_stats(pages).first()) == {0}
    rows = [(1, "http://a.b/", "<a href='http://c.d/'>x</a>", 200), (2, "http://a.b/2", "<a href='http://c.d/'>x</a>", 200), (3, "http://a.b/3", "", 200), (4, "http://e.f/", "x", 404), (5, "http://e.f/", "x", None)]
    r = reports.crawl_stats(spark.createDataFrame(rows, pages.schema)).first()
    assert (r.pages, r.failed, r.hosts, r.duplicates, r.bytes_saved) == (5, 3, 1, 1, len(rows[0][2]))
    names, versions = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 3), ("a", 5)], "k string, v int")
    assert sorted(map(tuple, reports.version_lookup(names, versions, "k", "v", 2).collect())) == [("a", 5, False), ("b", None, True)]
    assert sorted(map(tuple, reports.current_version(names, versions, "k", "v").collect())) == [("a", 5), ("b", 0)]
    assert reports.needs_analysis(spark.createDataFrame([(1, True, 0, 0.9), (2, True, 0, 0.8), (3, None, 0, 0.9)], "id long, success boolean, error_count int, quality double")).count() == 2
