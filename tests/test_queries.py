"""Every registered query against its SQL in DuckDB, and rules on small frames."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siltspark.operators import catalog, corpus, search, sessions
from siltspark.plans import registry
from siltspark.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else repr(round(float(v), 4)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Example.com:80/a/../b//c/./d#x", "http://example.com/b/c/d"), ("https://e.com", "https://e.com/"), ("https://e.com:443/a/?q=1 2", "https://e.com/a/?q=1%202"),
        ("http://e.com/../x", "http://e.com/x"), ("mailto:a@b.c", None), ("ftp://e.com/", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(corpus.canonical_url(F.col("u"))).first()[0] == want


def test_cosine(spark):
    cases = [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0)]
    got = spark.createDataFrame(cases, "a array<double>, b array<double>, w double").select(search.cosine(F.col("a"), F.col("b")).alias("c"), "w").collect()
    assert all(abs(r.c - r.w) < 1e-12 for r in got)


def test_redirects(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("m", "gone")], "url string, to string")
    got = {r.url: (r.target, r.reason) for r in corpus.resolve_redirects(a, 4).collect()}
    assert got["a"] == ("c", "ok") and got["x"][1] == "loop" and got["m"] == ("gone", "missing")


def test_validation(spark):
    e = spark.createDataFrame([("urn:air:a.com:x", "n", "t", "u", None), ("urn:air:a:x", "", "t", "u", "d")], "identifier string, display_name string, type string, url string, data string")
    got = [r.reasons for r in catalog.validate_entries(e).collect()]
    assert got == [[], ["display_name", "url or data", "urn"]]


def test_truncate_mid(spark):
    got = spark.createDataFrame([("abcdefghij",), ("abcd",)], "t string").select(sessions.truncate_mid(F.col("t"), 4)).collect()
    assert [r[0] for r in got] == ["ab\n[6 characters truncated]\nij", "abcd"]


def test_frontier_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"u{i % 5}",) for i in range(k, k + 4)], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.frontier_stream(stream, "url").writeStream.format("memory").queryName("frontier").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r.url for r in spark.table("frontier").collect())
    assert got == sorted(r.url for r in spark.read.parquet(str(tmp_path / "in")).distinct().collect())


@pytest.mark.parametrize("source, target, want", [("a/b", "a/b/c.html", "c.html"), ("a/b/x.html", "a/y.css", "../y.css"), ("a", "a", "."), ("", "k/l", "k/l"), ("a/b/c", "a/x", "../../x"), ("/a/", "b/", "../b")])
def test_rel_path(spark, source, target, want):
    assert spark.createDataFrame([(source, target)], "s string, t string").select(corpus.rel_path(F.col("s"), F.col("t"))).first()[0] == want


def test_references(spark):
    html = """<img src="a.png" srcset="b.png 1x, c.png 2x"><a href='d'>x</a><p style="background:url('e.gif')"></p><style>@import "f.css"; p{b:url(g.png)}</style><img src="a.png">"""
    got = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string").transform(corpus.all_refs).collect()
    assert sorted((r.page_id, r.kind, r.ref) for r in got) == [
        (1, "attribute", "a.png"), (1, "attribute", "d"), (1, "css", "e.gif"), (1, "css", "g.png"), (1, "import", "f.css"), (1, "srcset", "b.png"), (1, "srcset", "c.png"),
    ]


def test_vector_texts(spark):
    cases = [("[1.000000,-0.500000]", [1.0, -0.5]), ("[]", None), ("1,2", None), (" [x, 2] ", [0.0, 2.0]), (None, None)]
    got = spark.createDataFrame(cases, "t string, w array<float>").select(search.vec_parse(F.col("t")).alias("v"), "w").collect()
    assert all(r.v == r.w for r in got)


def test_policy(spark):
    calls = spark.createDataFrame([("Read",), ("write",), ("run",)], "name string")
    names = lambda *lists: sorted(r.name for r in sessions.apply_policy(calls, *lists).collect())
    assert names((), ()) == ["Read", "run", "write"] and names(("*",), ("read",)) == [] and names(("RUN",), ("*",)) == ["Read", "write"] and names((), ("read",)) == ["Read"]


def test_route_and_keywords(spark):
    rows = [("the cat AND the cat sat", "lexical", ["cat", "sat"]), ("explain it", "vector", ["explain"]), ("a b c d e f g h i j k", "hybrid", []), ("", "lexical", [])]
    got = spark.createDataFrame(rows, "t string, r string, k array<string>").select("r", "k", sessions.route(F.col("t")).alias("mode"), sessions.keywords(F.col("t")).alias("words")).collect()
    assert all(x.r == x.mode and x.k == x["words"] for x in got)


def test_hybrid_recall_without_vectors(spark):
    first = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id long, score double")
    vectors = spark.createDataFrame([(2, [1.0, 0.0])], "id long, vec array<double>")
    got = search.hybrid_recall(first, vectors, spark.createDataFrame([([1.0, 0.0],)], "q array<double>"), 5).collect()
    assert [(r.id, r.score) for r in got] == [(2, 0.85), (1, 0.3)]
