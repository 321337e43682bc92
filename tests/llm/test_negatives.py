"""Hard negatives against brute force, with ties, repeated rows, nulls, other lengths, small blocks and empty tables."""

import numpy as np
import pytest

from siltspark.llm import negatives


@pytest.mark.parametrize("most, fields", [(0, 26), (1, 5), (135, 2), (1000, 1), (2**24, 1)])
def test_packed_products(most, fields):
    rng = np.random.default_rng(most % 97)
    for dims in (0, 1, 64):
        a, c = rng.integers(-most, most + 1, (11, dims)), rng.integers(-most, most + 1, (37, dims))
        packed = negatives.Packed(c, int(a.min(initial=0)), int(a.max(initial=0)))
        assert (packed.scores(a) == (a.astype(object) @ c.T.astype(object) if dims else 0)).all()
    assert packed.fields == fields or most == 0 and packed.fields > 20


def test_best():
    none = negatives.NONE
    x = np.array([[3, 5, 5, none], [none] * 4, [1, none, none, none]])
    assert [(list(r), list(c)) for r, c in negatives.best(x, 3)] == [([0, 2], [1, 0]), ([0], [2]), ([0], [0])]


def brute(rows, asked, positives, negs, least, most):
    rows = {(i, label, tuple(v)) for i, label, v in rows if None not in (i, label) and v is not None and None not in v}
    out = []
    for i, label, v in rows:
        if not asked(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: B023, E731
        others = [(-score(w), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fit = sorted((t, k) for t, k, m in others if m != label and least * -s <= 100 * -t <= most * -s)[:negs]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def test_mine(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "BATCH", 3)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 6, (400, 6))  # many ties
    label = np.where(rng.random(400) < 0.35, 1, rng.integers(0, 8, 400))  # one label with a third of all rows
    rows = [(i, int(label[i]), [int(v) for v in x[i]]) for i in range(400)]
    rows += [rows[10], rows[10], (7, 1, [5] * 6), (None, 1, [5] * 6), (900, None, [5] * 6), (901, 1, None), (902, 1, [None] * 6), (910, 1, [2]), (911, 2, [1]), (920, 1, [3]), (930, 3, []), (940, 3, []), (950, 4, [])]
    items = spark.createDataFrame(rows, "id long, label int, vec array<long>").repartition(3)
    for least, most in ((50, 95), (0, 100)):
        got = sorted(map(tuple, negatives.mine(items.where("id % 10 = 0"), items, 5, 3, least, most).collect()))
        assert got == brute(rows, lambda i: i % 10 == 0, 5, 3, least, most) and len(got) > 100
    assert negatives.mine(items.limit(0), items).count() == negatives.mine(items, items.limit(0)).count() == 0
    assert negatives.mine(items.where("id = 0"), items.where("label = 1")).count() == 0


def test_products_beyond_the_bound(spark):
    big = spark.createDataFrame([(0, 1, [2**29]), (1, 1, [2**29])], "id long, label int, vec array<long>")
    with pytest.raises(Exception, match="beyond 55 bits"):
        negatives.mine(big, big).collect()


def test_op11_leaves_out_what_is_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(0.4, 0.3, 4)], int(rng.integers(0, 10))) for i in range(150)]
    rows += [(200, [nan] * 4, 1), (250, [inf, 1.0, 1.0, 1.0], 2), (300, None, 1), (350, [None, 1.0, 1.0, 1.0], 3), (400, [1.0] * 4, None), (450, [1.0] * 4, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = [(i, (m + 1) % 10 if i % 7 == 0 else m, [int(np.floor(256 * float(np.float32(a)))) for a in e]) for i, e, m in rows if m is not None and i not in (200, 250, 300, 350)]
    got = sorted(map(tuple, negatives.op11_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == brute(plain, lambda i: i % 50 == 0, 5, 3, 50, 95) and got
