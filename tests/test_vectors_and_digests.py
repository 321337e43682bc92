"""Nearest items of several vectors, digests of multisets and observed imports against plain computation."""

import numpy as np
from pyspark.sql import functions as F

from siltspark.operators import corpus, vectors
from siltspark.plans import jobs


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ITEMS", 64)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    rng = np.random.default_rng(2)
    rows = [(int(i // 3), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(400)]  # many ties and zero vectors
    rows += [(5, None), (None, [1.0] * 4), (6, [None, 1.0, 1.0, 1.0]), (7, [1.0, 2.0])]
    base = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    queries = base.where("id % 5 = 0")
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v]
    cosine = lambda a, b: round(float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 12) if a.any() and b.any() else 0.0
    for same in (False, True):
        got = {}
        for r in vectors.nearest(queries, base, 6, same).orderBy("q_id", "rank").collect():
            got.setdefault(r.q_id, []).append((r.b_id, round(r.score, 9)))
        for q in {i for i, _ in good if i % 5 == 0}:
            best = {}
            for a in (v for i, v in good if i == q):
                for i, b in good:
                    if len(a) == len(b) and (same or i != q):
                        best[i] = max(best.get(i, -2), cosine(a, b))
            assert got[q] == [(i, round(c, 9)) for i, c in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:6]]
    assert vectors.nearest(queries.limit(0), base, 3).count() == vectors.nearest(queries, base.limit(0), 3).count() == 0


def test_multiset_digest(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("", None), (None, ""), ("ab", "")], "x string, y string")
    digest = lambda d: tuple(corpus.multiset_digest(d, ["x", "y"]).first())
    want = digest(df)
    assert all(digest(df.repartition(n)) == want for n in (1, 4, 16)) and want[0] == 5
    others = [df.distinct(), df.union(df), df.where("x is not null"), df.withColumn("y", F.coalesce("y", F.lit(""))), df.select(F.concat("x", "y").alias("x"), F.lit("").alias("y")), df.limit(0)]
    assert len({digest(o) for o in others} | {want}) == 7


def test_import_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, 7, "n"), (2, None, "m"), (None, 7, "x"), (3, 8, None)], "k int, r int, name string")
    got = jobs.import_tables({"t": (t, "k", {"r": ("in", "r")}, ["name"]), "none": (t.limit(0), "k", {}, ["name"])}, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("none", 0, 0, 0), ("t", 4, 4, 1)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path)).collect())) == [("t/1", "in", "r/7"), ("t/1", "name", "n"), ("t/2", "name", "m"), ("t/3", "in", "r/8")]
