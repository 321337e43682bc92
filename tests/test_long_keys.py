"""Ranges with carried borders against windows, chains, archives of ranges, robots rules, and inputs that used to fail."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.operators import catalog, corpus, graph, longkeys, search
from siltspark.sources import ranged, tables


def test_lags_and_sums_equal_windows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "a", "b", None, f"k{i}"]), i // 2, i, None if i % 7 == 0 else i % 13) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at long, no long, v long").repartition(3)
    w = W.partitionBy("k").orderBy("at", "no")
    want = df.withColumns({"prev": F.lag("v").over(w), "s": F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)), "n": F.row_number().over(w).cast("long")})
    lagged = longkeys.lag_over(df, ["k"], ["at", "no"], "v", "prev", 7)
    assert sorted(map(repr, lagged.collect())) == sorted(map(repr, want.select("k", "at", "no", "v", "prev").collect()))
    sums = longkeys.running_sums(df.withColumn("one", F.lit(1)), ["k"], ["at", "no"], {"s": "v", "n": "one"}, 7)
    assert sorted(map(repr, map(tuple, sums.drop("one").collect()))) == sorted(map(repr, map(tuple, want.select("k", "at", "no", "v", "s", "n").collect())))
    assert longkeys.lag_over(df.limit(0), ["k"], ["at", "no"], "v", "prev", 3).count() == 0


def test_a_hot_key_fills_many_ranges(spark, tmp_path):
    df = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    ranged.write_segment(df, str(tmp_path), ("k", "at"), parts=6)
    sizes = [r.n for r in ranged.manifest(spark, str(tmp_path)).collect()]
    assert len(sizes) == 6 and max(sizes) < 3 * 3000 / 6


def test_chain(spark):
    rows = [(i, "abc"[i % 3], f"2024-01-01 00:00:{i % 60:02d}") for i in range(60)]
    signed = longkeys.sign_chain(spark.createDataFrame(rows, "event_id long, name string, ts string"), 4)
    assert {(r.name, r.broken, r.first_break) for r in longkeys.first_breaks(signed, 4).collect()} == {("a", 0, None), ("b", 0, None), ("c", 0, None)}
    bad = signed.where("event_id <> 9").withColumn("signature", F.when(F.col("event_id") == 31, "x").otherwise(F.col("signature"))).withColumn("previous_hash", F.when(F.col("event_id") == 2, "y").otherwise(F.col("previous_hash")))
    assert {(r.name, r.records, r.broken, r.first_break) for r in longkeys.first_breaks(bad, 4).collect()} == {("a", 19, 1, 12), ("b", 20, 1, 34), ("c", 20, 1, 2)}


def test_archive_look_up(spark, tmp_path):
    rows = [("A" if i % 4 else "B", f"u{i:03d}", i) for i in range(200)]
    tables.write_archive(spark.createDataFrame(rows, "ns string, url string, n int"), str(tmp_path), 8)
    keys = spark.createDataFrame([("A", "u001"), ("A", "u001"), ("A", "u003"), ("B", "u001"), ("Z", "z"), (None, "u002"), ("A", "u002x")], "ns string, url string")
    found = tables.archive_look_up(spark, str(tmp_path), keys)
    assert sorted((r.ns, r.url, r.n) for r in found.collect()) == [("A", "u001", 1), ("A", "u003", 3)]
    assert len(tables.archive_look_up(spark, str(tmp_path), keys.limit(1)).inputFiles()) == 1 < len(spark.read.parquet(f"{tmp_path}/rows").inputFiles())
    assert tables.archive_look_up(spark, str(tmp_path), keys.where("ns = 'Z'")).count() == 0


@pytest.mark.parametrize("path, rules, want", [
    ("/a/b.html", [("/a", False)], False), ("/a/b.html", [("/a", False), ("/a/b", True)], True), ("/b", [("/a", False)], True), ("/a", [("/a", False), ("/a", True)], True),
    ("/x/q.pdf", [("/*.pdf$", False)], False), ("/x/q.pdfs", [("/*.pdf$", False)], True), ("/x", [("*", False)], False), ("/a$b", [("/a$b", False)], False), ("/a(1).x", [("/a(1).*", False)], False),
    ("/a1", [("/a(1", False), ("/a.", False)], True), ("/p/", [("/p/$", False)], False), ("/p/q", [("/p/$", False), ("", False)], True), ("", [("/", False)], True), ("/a/z", [("/a/*", True), ("/a", False)], True),
])
def test_robots_rules(spark, path, rules, want):
    urls = spark.createDataFrame([(1, "h", path), (2, "other", path)], "page_id int, host string, path string")
    r = spark.createDataFrame([("h", p, a) for p, a in rules], "host string, rule_path string, allow boolean")
    assert {x.page_id: x.allowed for x in corpus.robots_allowed(urls, r).collect()} == {1: want, 2: True}


def test_a_host_with_many_rules(spark):
    urls = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("h").alias("host"), F.concat(F.lit("/p"), (F.col("id") * 7).cast("string")).alias("path"))
    rules = spark.range(10_000).select(F.lit("h").alias("host"), F.concat(F.lit("/p"), F.col("id").cast("string")).alias("rule_path"), (F.col("id") % 2 == 0).alias("allow"))
    got = {r.page_id: r.allowed for r in corpus.robots_allowed(urls, rules).collect()}
    longest = lambda n: next(int(str(n)[:k]) for k in range(len(str(n)), 0, -1) if int(str(n)[:k]) < 10_000)
    assert got == {i: longest(i * 7) % 2 == 0 for i in range(3000)}


def test_what_used_to_fail(spark):
    e = spark.createDataFrame([("urn:air:a.com:x", "n", "t", ["g"], ["c"]), ("no urn", "n", "t", ["g", "h"], []), ("urn:air", "n", None, [], []), (None, "n", "u", None, None)], "identifier string, display_name string, type string, tags array<string>, capabilities array<string>")
    assert {(r.facet, r.value): r.n for r in catalog.facets(e.where("tags is not null")).collect()} == {("type", "t"): 2, ("tag", "g"): 2, ("tag", "h"): 1, ("capability", "c"): 1, ("publisher", "a.com"): 1}
    assert [r.value for c in ("publisher", "type", "tags") for r in catalog.distinct_values(e, c).collect()] == ["a.com", "t", "u", "g", "h"]
    docs = spark.createDataFrame([(1, "a b")], "id long, t string")
    assert search.bm25_search(docs, "id", "t", " ", 3).count() == 0
    t = spark.createDataFrame([("s", "p", "o"), ("o", "q", "z")], "s string, p string, o string")
    assert graph.graph_context(t, []).count() == 0 and graph.graph_context(t, ["O"]).count() == 1
    assert graph.match(t, [("?x", "p", "?y"), ("?z", "r", "?w"), ("?y", "q", "?z")][::2]).first().z == "z"
    with pytest.raises(ValueError, match="no variable"):
        graph.match(t, [("?x", "p", "?y"), ("?v", "q", "?w")])
    far = graph.match(t, [("?x", "p", "?y"), ("?z", "?r", "?z2"), ("?y", "q", "?z")][:1] + [("?y", "q", "?z")])
    assert far.count() == 1


def test_catalog_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("urn:air:a.com:x", "n"), ("bad", "m")], "identifier string, display_name string")
    tables.write_catalog(e, str(tmp_path), "h.example", "1.1")
    got = tables.read_catalog_rows(spark, str(tmp_path), e.schema).collect()
    assert sorted((r.identifier, r.display_name, r.host, r.specVersion, r.publisher or "") for r in got) == [("bad", "m", "h.example", "1.1", ""), ("urn:air:a.com:x", "n", "h.example", "1.1", "a.com")]
