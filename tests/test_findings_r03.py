"""Cases of the third round's findings: queries against their SQL on odd inputs, and steps against plain forms."""

import re
from datetime import datetime, timedelta, timezone

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.functions import plugins
from siltspark.llm import lm, passages
from siltspark.llm.words import hash_words, mix64, shingles
from siltspark.operators import patterns, postings, search, sessions
from siltspark.plans import registry


def same(spark, folder, name, table, rows):
    """Whether a query on one made table gives what its SQL gives."""
    pq.write_table(rows, f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cur = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(folder)).select(*columns).collect()))) == sorted(map(repr, cur.fetchall()))


def test_eval_summary_minds_case(spark, tmp_path):
    texts = ["The " * 60, "the " * 60, "other " * 60, "the", None, ""]
    n = len(texts)
    same(spark, tmp_path, "eval_summary", "conversations", pa.table({"conv_id": pa.array(range(n), pa.int64()), "turn": pa.array([1] * n, pa.int64()), "role": ["assistant"] * n, "text": texts}))


def test_vec_format_rounds_as_printf(spark, tmp_path):
    vectors = [[0.0078125, -0.0078125, 0.0234375], [-1e-8, -0.0, 1e22], [float("inf"), float("-inf"), 3.4e38], [1.0, None, 2.5], [None], [], None]
    same(spark, tmp_path, "vec_format", "embeddings", pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}))


def test_search_many_moves_no_row_a_query_and_term(spark, tmp_path):
    """Postings meet candidates by key, and what a query and a document make is added up where it arises."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} w{i % 3}") for i in range(60)] + [(7, "alpha beta w0 w1"), (99, None), (100, "")], "doc_id long, text string")
    path = f"{tmp_path}/index"
    postings.add_documents(docs, path, "doc_id", "text")
    asked = spark.createDataFrame([(1, "alp w3"), (2, "beta alpha"), (3, "w"), (4, "none w1"), (5, "")], "query_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = postings.search_many(spark, path, asked, 9)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, term", plan)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.score))
    for q, text in [(1, "alp w3"), (2, "beta alpha"), (3, "w"), (4, "none w1"), (5, "")]:
        assert got.get(q, []) == [tuple(r) for r in search.bm25_search(docs, "doc_id", "text", text, 9).collect()]


def test_words_of_a_document_are_counted_in_its_row(spark):
    got = spark.createDataFrame([(["b", "a", "b", "a", "b"],), ([],), (None,), (["x"],)], "w array<string>").select(postings._counted(F.col("w")).alias("c")).collect()
    assert [r.c and [tuple(x) for x in r.c] for r in got] == [[("a", 2), ("b", 3)], [], None, [("x", 1)]]


def test_knn_equals_pairs(spark, monkeypatch):
    """Blocks give what all pairs of rows give: ties by the smaller id, rounding borders, unequal lengths, zero, null and odd vectors."""
    rng = np.random.default_rng(3)
    odd = [[0.0, 0.0, 0.0], [1.0, 2.0], None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], []]
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(140)] + [(200 + i, v) for i, v in enumerate(odd)]
    v = spark.createDataFrame(rows, "id long, vec array<float>")
    monkeypatch.setattr(search, "ITEMS", 50)
    monkeypatch.setattr(search, "QUERIES", 20)
    for same in (False, True):
        q, b = v.where("id % 3 = 0").toDF("q_id", "q"), v.toDF("b_id", "b")
        pairs = q.crossJoin(b).where(F.lit(same) | (F.col("q_id") != F.col("b_id"))).select("q_id", "b_id", F.round(search.cosine(F.col("q"), F.col("b")), 4).alias("score"))
        want = pairs.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "b_id"))).where("rank <= 10")
        text = lambda df: sorted(map(repr, df.select("q_id", "b_id", "score", "rank").collect()))
        assert text(search.knn(v.where("id % 3 = 0"), v, 10, same)) == text(want)
    assert search.knn(v.where("id < 0"), v, 10).count() == search.knn(v, v.limit(0), 10).count() == 0


def test_rolling_count_has_no_sliding_frame(spark):
    rows = [(i, "ab"[i % 2], datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=h), ok) for i, (h, ok) in enumerate([(0, True), (0, True), (24, True), (24, True), (12, True), (36, True), (12, False), (30, True), (30, True), (100, True), (6, True), (30, True), (-5, True), (-5, True)])]
    h = spark.createDataFrame(rows, "event_id long, name string, ts timestamp, applied boolean")
    got = sessions.rolling_count(h, 24, 3)
    assert "specifiedwindowframe(RangeFrame, -" not in got._jdf.queryExecution().toString()
    count = lambda r: sum(x[1] == r[1] and x[3] and r[2] - timedelta(hours=24) < x[2] <= r[2] for x in rows)
    assert sorted((r.event_id, r.n, r.allowed) for r in got.collect()) == [(r[0], count(r), count(r) < 3) for r in rows if r[3]]


def test_texts_become_objects_in_small_numbers(spark):
    """Embedders get batches, and neither they nor patterns hold the objects of a whole Arrow batch."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i) for i in range(23)], "id long, text string").coalesce(1)
    got = {r.id: r.vec for r in plugins.embed(df, "text", lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch=4).collect()}
    known = [i for i in range(23) if i % 5]
    assert got == {i: [float(i), float(min(4, len(known) - known.index(i) // 4 * 4))] if i % 5 else None for i in range(23)}
    assert plugins.embed(df.where("text is null"), "text").where("vec is not null").count() == 0 and plugins.embed(df.limit(0), "text").count() == 0
    held = patterns._pass(df.withColumn("_text", F.col("text")), ["id"], [(1, "xx")], [])
    assert sorted((r.id, r.n) for r in held.collect()) == [(i, i // 2) for i in known if i > 1] and patterns.ROWS <= 256


def test_lm_messages_become_objects_a_kind_at_a_time():
    t = pa.table({"kind": pa.array([0, 1, 0], pa.int32()), "keys": pa.array([b"a", b"b", b"c"])})
    assert [x["keys"] for x in lm._of(t, 0)] == [b"a", b"c"] and [x["keys"] for x in lm._of(t, 1)] == [b"b"] and lm._of(t, 2) == []


def least_line(rng):
    """36 words whose shingles have very small values for all hash functions amid them, so that windows around have their minimum there."""
    text = np.array(["k%d" % x for x in rng.integers(10**9, size=400_000)])
    values, _ = shingles(*hash_words(pa.array([" ".join(text)])), passages.SHINGLE)
    hashed = [mix64(values + np.uint64(f * 0x9E3779B97F4A7C15 & (2**64 - 1))) for f in range(passages.HASHES)]
    for at in np.flatnonzero(hashed[0] < 2**64 // 200):
        if 40 < at < len(values) - 40 and all(h[at - 16 : at + 16].argmin() == 16 and h[at - 16 : at + 16].min() < 2**64 // 200 for h in hashed):
            return text[at - 16 : at + 20].tolist()


def test_passages_of_a_line_that_many_texts_have(spark, monkeypatch):
    """Of 60 texts with one line, three pairs are similar beyond it, each only to each other, and differ where probes beside the line are."""
    rng = np.random.default_rng(5)
    w = lambda k: ["w%d" % rng.integers(10**6) for _ in range(k)]
    line, rows = least_line(rng), [(0, None), (1, "")]
    for k in range(54):
        rows.append((100 + k, " ".join(w(29) + line + w(30))))
    for k in range(3):
        before, after = w(29), w(30)
        for other in ("x", "y"):
            rows.append((2 * k + 10 + (other == "y"), " ".join(before[:27] + [other] + before[28:] + line + after[:2] + [other] + after[3:])))
    for block in (2048, 16):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = {}
        for r in passages.repeated_passages(spark.createDataFrame(rows, "row_key long, text string").repartition(3)).collect():
            got.setdefault(r.passage_id, set()).add(r.row_key)
        assert sorted(map(sorted, got.values())) == [[10, 11], [12, 13], [14, 15]], block


def test_inside_of_runs():
    rng = np.random.default_rng(2)
    for p in range(1, passages.PERIOD + 1):
        head, run, tail = rng.integers(1, 2**60, 9), np.tile(rng.integers(1, 2**60, p), 30), rng.integers(1, 2**60, 7)
        values = np.concatenate([head, run, tail, head, run]).astype(np.uint64)
        offsets = np.array([0, 16 + 30 * p, len(values), len(values)])
        row, c = np.repeat([0, 1], np.diff(offsets)[:2]), np.concatenate([np.arange(n) for n in np.diff(offsets)[:2]])
        q = -(-(passages.SLACK + 1) // p) * p
        for i, x, y in zip(row, c, passages.inner(values, offsets, row, c)):
            assert y == (9 + q <= x < 9 + 30 * p - q), (p, i, x)
