"""Exact top-k by inner product, with no random access (NRA).

Each dimension of a block of items is a list sorted by value; a query reads it from the end that its own
sign favours.  Lists are read in steps, all to the same depth, and every entry read is added to its item's
sum.  An item's lower bound takes its unread entries at the list's worst value, its upper bound at the
value that the list has reached.  A query stops once no item outside its k best lower bounds has an upper
bound that reaches the k-th of them; then the scores of these k are resolved.  Lists that are read out
give exact sums, so a query that can't stop earlier needs nothing else.  The queries of a batch read
together and leave it one by one.

Items lie in blocks, and a task holds one block of items and one of queries.  A block of queries is eight
times as large, as items travel once for each block of queries and queries once for each block of items.
The blocks' best k meet in a window per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.llm.common import table

#: Depths, as shares of the lists, at which the bounds are compared.
DEPTHS = (0.05, 0.2, 0.4, 0.6, 0.8, 1.0)
ITEMS, QUERIES, BATCH = 4096, 32_768, 256


def _exact_type(queries: np.ndarray, items: np.ndarray) -> type:
    """A type in which every sum of products is exact."""
    bound = 2.0 * queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(items).max(initial=0))
    if bound >= 2**62:
        raise ValueError("inner products beyond 64 bits")
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Lists:
    """The sorted lists of a block of items, one a dimension."""

    def __init__(self, items: np.ndarray):
        self.n, self.dims = items.shape
        self.order = np.argsort(items, axis=0, kind="stable")
        self.values = np.take_along_axis(items, self.order, axis=0)
        self.least, self.most = self.values[0], self.values[-1]


def nra(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row of the query, item id, score)`` of each query's k best items, ties to the smaller id, and the share of the lists that each query read.

    Items with the query's own id take no part.
    """
    kind = _exact_type(queries, items)
    lists = Lists(items.astype(kind))
    read = np.ones(len(queries))
    found = [_batch(query_ids, queries.astype(kind), ids, lists, items.astype(kind), k, np.arange(lo, min(lo + BATCH, len(queries))), read) for lo in range(0, len(queries), BATCH)]
    rows, cols, scores = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order].astype(np.int64)
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[cols[keep]], scores[keep], read


def _batch(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, lists: Lists, items: np.ndarray, k: int, live: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries and items, with scores, that hold the k best of each live query."""
    n, kind = lists.n, items.dtype
    lowest = np.iinfo(np.int64).min if kind == np.int64 else -np.inf
    up, down = np.maximum(queries[live], 0), np.minimum(queries[live], 0)  # which end of a list a query reads
    sums = np.zeros((len(live), n), kind)
    unread_top, unread_bottom = np.ones(items.shape, kind), np.ones(items.shape, kind)
    column = np.arange(lists.dims)
    out, at = [], 0
    for depth in DEPTHS:
        to = min(n, max(at + 1, int(np.ceil(n * depth))))
        for ends, weight, unread in ((slice(n - to, n - at), up, unread_top), (slice(at, to), down, unread_bottom)):
            entries = np.zeros(items.shape, kind)
            entries[lists.order[ends], column] = lists.values[ends]
            unread[lists.order[ends], column] = 0
            sums += weight @ entries.T
        at = to
        own = query_ids[live][:, None] == ids[None, :]
        if at == n:
            lower = upper = np.where(own, lowest, sums)
        else:
            bound = lambda top, bottom: sums + (up * top) @ unread_top.T + (down * bottom) @ unread_bottom.T
            lower, upper = bound(lists.least, lists.most), bound(lists.values[n - at], lists.values[at - 1])
            lower[own] = upper[own] = lowest
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(live), lowest)
        may = (upper >= kth[:, None]) & ~own  # ties with the k-th are kept until the sums are exact
        done = np.full(len(live), True) if at == n else may.sum(axis=1) <= k
        for q in np.flatnonzero(done):
            cols = np.flatnonzero(may[q])
            out.append((np.full(len(cols), live[q]), cols, sums[q, cols] if at == n else items[cols] @ queries[live[q]]))
            read[live[q]] = at / n
        stay = ~done
        if not stay.any():
            break
        live, up, down, sums = live[stay], up[stay], down[stay], sums[stay]
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = t.column("vec").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return t.column("id").to_numpy(), flat.reshape(t.num_rows, len(flat) // t.num_rows)


def _block_topk(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        if not queries.num_rows or not items.num_rows:
            return pa.table({"q": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        query_ids, vectors = _matrix(queries)
        rows, ids, scores, _ = nra(query_ids, vectors, *_matrix(items), k)
        return pa.table({"q": queries.column("q").to_numpy()[rows], "query_id": query_ids[rows], "vec_id": ids, "score": scores})

    return run


def topk_inner_product(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Each query's k items of the highest inner product: query_id, rank (from 1), vec_id, score.

    queries, items: ``id long, vec array<long>``; other columns are ignored.  Ties go to the smaller
    id, and an item with the query's own id is never returned.  Rows with a null id, a null vector or
    a null component take no part.  Repeated items are each an item; queries that repeat id and vector
    are one query, and of queries that share an id only each has its own ranks.  Only vectors of equal
    length meet; empty ones do with a score of 0.  Empty inputs give no rows.  A task holds one block of queries and one of items.
    """
    good = "id is not null and vec is not null and not exists(vec, x -> x is null)"
    queries = queries.select("id", "vec").where(good).distinct().withColumn("q", F.xxhash64("id", "vec"))
    items = items.select("id", "vec").where(good).withColumn("no", F.monotonically_increasing_id())
    n_q, n_i = max(1, -(-queries.count() // QUERIES)), max(1, -(-items.count() // ITEMS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("q", "id", "vec", F.size("vec").alias("d"), F.pmod("q", F.lit(n_q)).cast("int").alias("qb"), every(n_i).alias("ib"))
    right = items.select("id", "vec", F.size("vec").alias("d"), F.pmod(F.xxhash64("no"), F.lit(n_i)).cast("int").alias("ib"), every(n_q).alias("qb"))
    found = left.groupBy("qb", "ib", "d").cogroup(right.groupBy("qb", "ib", "d")).applyInArrow(_block_topk(k), "q long, query_id long, vec_id long, score long")
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 of every row for the rows whose vec_id is divisible by 20; components as floor(64 * x)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    good = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    items = e.where(f"embedding is not null and {good}").select(
        F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> cast(floor(64 * cast(x as double)) as bigint))").alias("vec")
    )
    return topk_inner_product(items.where("id % 20 = 0"), items, 20)


OP1_SQL = """
WITH items AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, i.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, i.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM items q JOIN items i ON q.vec_id <> i.vec_id AND len(q.v) = len(i.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
