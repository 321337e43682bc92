"""Periodic runs against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siltspark.llm import runs


def brute(words):
    """Every stretch that keeps a period, tried for each period; the smallest period of a stretch stays."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_find_runs():
    rng = random.Random(1)
    total = 0
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            v = rng.choice([1, 2, 3, 8])
            some = lambda n: [b"%d" % rng.randrange(v) for _ in range(n)]  # noqa: B023, E731
            w = some(rng.choice([0, 1, 3, 10, 40, 120]))
            if rng.random() < 0.5:
                p = some(rng.randint(1, 9))
                w = w + p * rng.randint(2, 9) + w[: rng.randint(0, 5)] + p * rng.randint(1, 6)
            texts.append(w)
        want = [brute(t) for t in texts]
        assert runs.find_runs(texts) == want
        total += sum(map(len, want))
    assert total > 500
    assert runs.find_runs([]) == [] and runs.find_runs([[], []]) == [[], []]


@pytest.mark.parametrize("chunk", [1, 50])
def test_children_in_small_chunks(monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    texts = [[b"a"] * 40 + [b"b", b"c"] * 9 + [b"a"] * 7, [b"x"]]
    assert runs.find_runs(texts) == [brute(t) for t in texts]


def test_long_texts():
    assert runs.find_runs([[b"a"] * 200_000, [b"%d" % (i % 7) for i in range(100_001)], [b"%d" % i for i in range(50_000)]]) == [[(0, 200_000, 1)], [(0, 100_001, 7)], []]


def test_collapse_runs(spark):
    rows = [(1, "A b A b A b A b x", 1), (1, "A b A b A b A b x", 1), (2, None, 2), (3, "", 3), (4, " \t\n\x0b ", 4), (5, "a A a A a a", 5), (None, "z  z\nz z z\tz", 6), (6, "é  é  é  é  é  é ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs long").repartition(3)
    got = runs.collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    found = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    ab = (1, [(0, 8, 2)], "A b x")
    assert found == [(0, [(0, 6, 1)], "z"), ab, ab, (2, [], ""), (3, [], ""), (4, [], ""), (5, [], "a A a A a a"), (6, [(0, 6, 1)], "é ")]
    assert runs.collapse_runs(docs.limit(0)).count() == 0
    best = docs.sparkSession.range(1).select(F.expr("array(named_struct('start', 0L, 'length', 8L, 'period', 2L), named_struct('start', 4L, 'length', 9L, 'period', 2L), named_struct('start', 9L, 'length', 18L, 'period', 4L))").alias("r"))
    assert tuple(best.select(runs.greatest_exponent("r").alias("b")).first().b) == (4, 9, 2)


def test_op12_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    # ids whose checksum is a multiple of 10 get a tail
    ids = [i for i in range(4000) if zlib.crc32(b"%d" % i) % 10 == 0][:25] + list(range(40))
    rows = [(i, " ".join(rng.choice(["a", "b"] if i % 3 else ["u%d" % k for k in range(50)]) for _ in range(rng.choice([0, 1, 2, 9, 60, 150])))) for i in ids]
    rows += [(ids[0], None), (ids[1], "one"), (None, "t " * 12), rows[0], rows[2], (ids[3], "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, runs.op12_periodic_runs(spark, str(tmp_path)).collect())))
    want = []
    for i, t in rows:
        w = (t or "").split()
        h, n = zlib.crc32(b"%d" % i) if i is not None else 1, len((t or "").split())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(map(repr, want)) and sum(x[1] for x in want) > 20
