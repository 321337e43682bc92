"""Hard negatives by Kronecker-packed products.

Components are biased to be no less than 0, and those of several candidates are laid side by side as fields of one
wide number.  A field holds any score of biased components, so one product an anchor component adds to all fields at
once and none runs over into the next; the sum of products is taken apart at the fields' borders, and what the bias adds
to a score, known from sums of components, is taken off.  The numbers are the 53 bits of a float64, in which all these
sums are whole and exact, so that matrix products do the work.

Candidates lie in blocks, and a task holds one block of candidates and one of anchors.  A first round finds each
anchor's positives inside its label; a second one scores the candidates of other labels against the bounds that the
positives set.  Each block gives its best few, and these meet in a window for each anchor or positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.llm.common import saved, table, work_dir

CANDIDATES, ANCHORS, BATCH = 4096, 32_768, 256
NONE = np.iinfo(np.int64).min
#: Scores below this size stay exact when multiplied by a percentage.
LARGEST = 2**55


class Packed:
    """Candidates, a row each, as wide numbers: those of column j of the packed matrix have their components in its fields."""

    def __init__(self, candidates: np.ndarray, low: int, high: int):
        """low, high: bounds of the anchors' components."""
        self.n, dims = candidates.shape
        self.low, self.least = low, int(candidates.min(initial=0))
        most = max(1, dims * (high - low) * (int(candidates.max(initial=0)) - self.least))
        self.width = most.bit_length()
        self.fields = max(1, 53 // self.width)
        # beyond 53 bits a number of any size takes the float's place, with one field
        kind = np.float64 if self.width <= 53 else object
        biased = np.zeros((dims, -(-self.n // self.fields) * self.fields), kind)
        biased[:, : self.n] = (candidates.astype(object) if kind is object else candidates - self.least).T
        if kind is object:
            biased[:, : self.n] -= self.least
        self.numbers = sum(biased[:, k :: self.fields] * kind(2 ** (self.width * k)) if kind is np.float64 else biased for k in range(self.fields))
        self.sums = candidates.sum(axis=1, dtype=np.int64)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner product of each anchor with each candidate."""
        kind = self.numbers.dtype
        wide = (anchors.astype(object) - self.low if kind == object else (anchors - self.low).astype(kind)) @ self.numbers
        if kind == object:
            out = wide
        else:
            wide, mask = wide.astype(np.int64), (1 << self.width) - 1
            out = np.empty((len(anchors), wide.shape[1] * self.fields), np.int64)
            for k in range(self.fields):
                out[:, k :: self.fields] = (wide >> (self.width * k)) & mask
            out = out[:, : self.n]
        # (a - low) (c - least) is a c - low c - least a + low least
        dims = anchors.shape[1]
        out = out + self.low * self.sums + (self.least * anchors.sum(axis=1, dtype=np.int64))[:, None] - dims * self.low * self.least
        return out.astype(np.int64)


def best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, columns)`` of each row's k highest scores, one of each row at a time; the first of equal ones, and none that is NONE.  Overwrites scores."""
    rows = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        columns = scores[rows].argmax(axis=1)
        there = scores[rows, columns] != NONE
        rows, columns = rows[there], columns[there]
        if not len(rows):
            return
        yield rows, columns
        scores[rows, columns] = NONE


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, -1)


def _block(anchors: pa.Table, candidates: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors' components, and the candidates' ids, labels and components by id."""
    candidates = candidates.take(pa.array(np.argsort(candidates.column("id").to_numpy(), kind="stable")))
    a, c = _matrix(anchors), _matrix(candidates)
    if max(1, a.shape[1]) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) >= LARGEST:
        raise ValueError("inner products beyond 55 bits")
    return a, candidates.column("id").to_numpy(), candidates.column("label").to_numpy(), c


def _result(names: str, parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names.split())
    return pa.table(dict(zip(names.split(), columns)))


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            a, ids, labels, c = _block(anchors, candidates)
            keys, own, of = (anchors.column(x).to_numpy() for x in ("a", "id", "label"))
            low, high = int(a.min(initial=0)), int(a.max(initial=0))
            for label in np.unique(of):
                rows, columns = np.flatnonzero(of == label), np.flatnonzero(labels == label)
                if not len(columns):
                    continue
                packed = Packed(c[columns], low, high)
                for lo in range(0, len(rows), BATCH):
                    here = rows[lo : lo + BATCH]
                    scores = packed.scores(a[here])
                    scores[own[here][:, None] == ids[columns][None, :]] = NONE
                    kept = scores.copy()
                    parts += [(keys[here[r]], ids[columns[x]], kept[r, x]) for r, x in best(scores, k)]
        return _result("a positive_id positive_score", parts)

    return run


def _negatives(k: int, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            a, ids, labels, c = _block(anchors, candidates)
            keys, own, of = (anchors.column(x).to_numpy() for x in ("a", "id", "label"))
            bounds = anchors.column("positives").combine_chunks()
            counts, flat = np.diff(bounds.offsets.to_numpy()), bounds.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(counts)])
            packed = Packed(c, int(a.min(initial=0)), int(a.max(initial=0)))
            for lo in range(0, len(a), BATCH):
                here = np.arange(lo, min(lo + BATCH, len(a)))
                scores = packed.scores(a[here])
                other = (own[here][:, None] != ids[None, :]) & (of[here][:, None] != labels[None, :])
                for p in range(int(counts[here].max(initial=0))):
                    rows = np.flatnonzero(counts[here] > p)
                    bound = flat[first[here[rows]] + p][:, None]
                    s = scores[rows]
                    fits = np.where(other[rows] & (least * bound <= 100 * s) & (100 * s <= most * bound), s, NONE)
                    for r, x in best(fits, k):
                        parts.append((keys[here[rows[r]]], np.full(len(r), p + 1), ids[x], s[r, x]))
        return _result("a p negative_id negative_score", parts)

    return run


def mine(anchors: DataFrame, items: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    anchors, items: ``id long, label, vec array<long>``; other columns are ignored.  An anchor's positives are the other
    items of its label with the highest inner products; a positive's negatives are the first items of other labels whose
    score is least to most per cent of the positive's.  Ties go to the smaller id; rank counts from 1 within a positive.
    Fewer are given where there are fewer, and a positive without any has no row.  Rows with a null id, label, vector or
    component take no part.  Repeated rows count once; rows that share only an id are each a row, and none of an anchor's
    own id is its positive or negative.  Only vectors of equal length meet.  Products of 2 ** 55 or more raise an error.
    Empty inputs give no rows.  A task holds one block of anchors and one of items, whatever label they have.
    """
    good = "id is not null and label is not null and vec is not null and not exists(vec, x -> x is null)"
    cols = ("id", F.col("label").cast("long").alias("label"), "vec", F.size("vec").alias("d"))
    anchors = anchors.where(good).select(*cols).distinct().withColumn("a", F.xxhash64("id", "label", "vec"))
    items = items.where(good).select(*cols).distinct()
    n_a, n_i = max(1, -(-anchors.count() // ANCHORS)), max(1, -(-items.count() // CANDIDATES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = items.withColumn("ib", F.pmod(F.xxhash64("id", "vec"), F.lit(n_i)).cast("int")).select("*", every(n_a).alias("ab")).groupBy("ab", "ib", "d")
    place = lambda df: df.withColumn("ab", F.pmod("a", F.lit(n_a)).cast("int")).select("*", every(n_i).alias("ib")).groupBy("ab", "ib", "d")
    near = place(anchors).cogroup(right).applyInArrow(_positives(positives), "a long, positive_id long, positive_score long")
    order = W.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives)
    # a list of `positives` scores at most for each anchor
    listed = near.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "positive_id", "positive_score"))), lambda x: F.struct(x["positive_id"].alias("id"), x["positive_score"].alias("score"))).alias("of"))
    bounded = saved(anchors.join(listed, "a"), work_dir(anchors.sparkSession), "positives")  # read twice below
    asked = bounded.select("a", "id", "label", "vec", "d", F.transform("of", lambda x: x["score"]).alias("positives"))
    far = place(asked).cogroup(right).applyInArrow(_negatives(negatives, least, most), "a long, p long, negative_id long, negative_score long")
    order = W.partitionBy("a", "p").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    found = far.join(bounded.select("a", F.col("id").alias("anchor_id"), "of"), "a").withColumn("at", F.element_at("of", F.col("p").cast("int")))
    return found.select("anchor_id", F.col("at.id").alias("positive_id"), "rank", "negative_id", F.col("at.score").alias("positive_score"), "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50; components as floor(256 * x), every seventh label moved on by one."""
    e = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    items = e.select(
        F.col("vec_id").alias("id"), F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"),
        F.expr("transform(embedding, x -> cast(floor(256 * cast(x as double)) as bigint))").alias("vec"),
    )
    return mine(items.where("id % 50 = 0"), items)


OP11_SQL = """
WITH items AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, i.id AS id, i.label AS label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, i.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM items a JOIN items i ON a.id <> i.id AND len(a.v) = len(i.v) WHERE a.id % 50 = 0
), positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""
