"""Stored postings, searches and recall for tables of queries, and pattern scans, against their one-query forms and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltspark.operators import patterns, postings, search
from siltspark.plans import jobs
from siltspark.sources import ranged

QUERIES = ["be", "Alpha be", '"beta" ga*', "(delta)", "al al be", "gamma delta beta alpha", "", "zzz", None, "*"]


def texts(n, seed=2):
    rng = random.Random(seed)
    words = ["alpha", "beta", "bet", "gamma", "delta", "Alphabet", "gam-ma", "über"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40]))) if i % 11 else None) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(120), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    assert postings.add_documents(docs.where("doc_id % 3 > 0"), path, "doc_id", "text", 5) == 0
    assert postings.add_documents(docs.where("doc_id % 3 = 0"), path, "doc_id", "text", 2) == 1
    return path


@pytest.mark.parametrize("query", ['"beta" ga*', "", "zzz"])
def test_stored_search_equals_search(spark, docs, index, query):
    want = [tuple(r) for r in search.bm25_search(docs, "doc_id", "text", query, 7).collect()]
    assert [tuple(r) for r in postings.stored_search(spark, index, query, 7).collect()] == want


def test_search_many_equals_searches(spark, docs, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    got = {}
    for r in postings.search_many(spark, index, asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.score))
    for i, q in enumerate(QUERIES):
        if i in (0, 2, 4, 5):
            assert got[i] == [tuple(r) for r in search.bm25_search(docs, "doc_id", "text", q, 7).collect()]
    assert set(got) == set(range(6))
    assert postings.search_many(spark, index, asked.limit(0), 7).count() == 0


def test_only_files_with_the_terms_are_read(spark, index):
    words = spark.createDataFrame([("del", False)], "word string, whole boolean")
    read = postings.postings_of(spark, index, words)
    every = spark.read.parquet(f"{index}/postings/rows").inputFiles()
    assert 0 < len(read.inputFiles()) < len(every) and {r.term for r in read.collect()} >= {"delta"}
    assert "segment" in read._jdf.queryExecution().toString() and postings.postings_of(spark, index, words.where("word = 'x'")).count() == 0


def test_an_unfinished_segment_is_not_seen(spark, docs, index, tmp_path):
    import shutil

    path = str(tmp_path / "copy")
    shutil.copytree(index, path)
    postings.add_documents(docs.limit(9), path, "doc_id", "text")
    shutil.rmtree(f"{path}/totals/segment=2")  # as if the writer had been stopped before the last step
    assert postings.stored_search(spark, path, "be", 9).collect() == postings.stored_search(spark, index, "be", 9).collect()
    postings.compact(spark, path, f"{path}2", 3)
    assert postings.stored_search(spark, f"{path}2", "be", 9).collect() == postings.stored_search(spark, index, "be", 9).collect()
    assert ranged.next_segment(spark, f"{path}2/postings") == 1
    assert {(r.term, r.df, r.cf) for r in postings.stored_terms(spark, path).collect()} == {tuple(r) for r in search.term_stats(docs, "doc_id", "text").collect()}


def test_an_empty_index(spark, docs, tmp_path):
    path = str(tmp_path)
    postings.add_documents(docs.limit(0), path, "doc_id", "text", 2)
    assert postings.stored_search(spark, path, "be", 5).count() == 0
    postings.add_documents(docs, path, "doc_id", "text", 2)
    assert postings.stored_search(spark, path, "be", 5).collect() == search.bm25_search(docs, "doc_id", "text", "be", 5).withColumnRenamed("doc_id", "key").collect()


def test_recall_all_equals_recall(spark):
    said = [(i // 4, i % 3, i % 4, "user", t or "") for i, t in texts(160, 5)]
    m = spark.createDataFrame(said, "session_id long, user_id long, turn long, role string, content string")
    memories = spark.createDataFrame([(1, 0, "the alpha BETA of it"), (2, 1, "beta"), (3, 0, None)], "memory_id long, user_id long, memory string")
    asked = ["alpha beta", "beta", "explain beta", "bet gam", "alpha beta gamma delta bet alpha bet beta gamma delta alpha", "mean", "lpha b", " "]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    rows = lambda df: sorted((r.id, r.preview, r.score) for r in df.collect())
    got = {}
    for r in jobs.recall_all(m, q, memories, 6, pool=15).collect():
        got.setdefault(r.query_id, []).append((r.id, r.preview, r.score))
    for i, text in list(enumerate(asked))[1:6:2]:
        assert sorted(got.get(i, [])) == rows(jobs.recall(m, memories, text, 6, pool=15)), text
    assert 7 not in got and len(got) >= 5
    # limited to a session, a user, both or none
    limits = [(0, "beta", None, None), (1, "beta", 3, None), (2, "beta", None, 1), (3, "beta", 3, 1), (4, "beta", 99, 1)]
    q = spark.createDataFrame(limits, "query_id long, text string, session_id long, user_id long")
    where = {f"{s}:{t}": (s, u) for s, u, t, _, _ in said}
    n = {}
    for r in jobs.recall_all(m, q, memories, 500, pool=500).collect():
        n[r.query_id] = n.get(r.query_id, 0) + 1
        _, _, session, user = limits[r.query_id]
        if r.preview.startswith("[Memory]"):
            assert user is None or r.id == "2"
        else:
            assert session in (None, where[r.id][0]) and user in (None, where[r.id][1])
    held = lambda session, user: sum("beta" in c.lower() and session in (None, s) and user in (None, u) for s, u, _, _, c in said)
    assert n == {i: held(s, u) + (2 if u is None else 1) for i, _, s, u in limits}


def test_find_patterns(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abB é") for _ in range(rng.choice([0, 3, 60])))) for i in range(80)] + [(80, None), (0, "abab"), (81, "İa"), (82, "ab é" * 50_000)]
    pats = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(100, "AB"), (101, "ab"), (102, ""), (103, None)]
    regexes = [(200, "a+b"), (201, "^B"), (202, "[é ]{2}")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    p = spark.createDataFrame([(i, x, False) for i, x in pats] + [(i, x, True) for i, x in regexes], "pattern_id long, pattern string, regex boolean")
    want = []
    for k, t in rows:
        low = (t or "").lower() if t != "İa" else "i̇a"
        for i, x in pats:
            if x and x.lower() in low:
                want.append((k, i, low.index(x.lower()), low.count(x.lower())))
        for i, x in regexes:
            found = [m.start() for m in re.finditer(x, low, re.I)]
            if found:
                want.append((k, i, found[0], len(found)))
    for chars in (patterns.AUTOMATON_CHARS, 40):
        monkeypatch.setattr(patterns, "AUTOMATON_CHARS", chars)
        assert sorted(map(tuple, patterns.find_patterns(df, ["k"], "t", p).collect())) == sorted(want)
    assert patterns.find_patterns(df, ["k"], "t", p.limit(0)).count() == patterns.find_patterns(df.limit(0), ["k"], "t", p).count() == 0


def test_ten_thousand_rules(spark):
    rules = spark.createDataFrame([(f"w{i} ", f"r{i % 7}") for i in range(10_000)] + [("w5 ", "r5")], "pattern string, risk string")
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("xW"), F.col("id").cast("string"), F.lit(" w5 ")).alias("text"))
    got = sorted((r.doc_id, r.pattern, r.risk) for r in patterns.scan_commands(docs, rules).collect())
    want = {(i, f"w{i} ", f"r{i % 7}") for i in range(500)} | {(i, "w5 ", "r5") for i in range(500)}
    assert got == sorted(want)


def test_known_risks(spark):
    rows = [(1, "sudo rm -rf / now"), (2, "/tmp/x --help"), (3, "cat /tmp/x"), (4, r"C:\Temp\a.exe"), (5, r"c:\temp\a.exe"), (6, "RM -r /home/.ssh"), (7, "ls /.x"), (8, "curl x -F a@b"), (9, None), (10, "")]
    got = {}
    for r in patterns.scan_commands(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.risk)
    assert got == {1: {"destructive recursive deletion of root", "needs approval"}, 2: {"binary in temporary directory"}, 4: {"binary in temporary directory"}, 6: {"deletion of hidden files"}}
