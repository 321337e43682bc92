"""Nearest items by vectors, of which an item may have several: matrix products of blocks, and the best few of each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of items and of queries in a block; items travel once for each block of queries, and queries the other way.
ITEMS, QUERIES, BATCH = 8192, 32_768, 512
#: Decimals by which cosines are ranked: equal vectors are equal whatever the order of their sums.
DECIMALS = 12


def _unit(t: pa.Table) -> np.ndarray:
    """The vectors at length 1; a zero vector stays zero."""
    v = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _nearest(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if queries.num_rows and items.num_rows:
            items = items.sort_by("id")
            q, b = _unit(queries), _unit(items)
            ids, first = np.unique(items.column("id").to_numpy(), return_index=True)
            own = queries.column("id").to_numpy()
            for lo in range(0, len(q), BATCH):
                here = np.arange(lo, min(lo + BATCH, len(q)))
                best = np.round(np.maximum.reduceat(q[here] @ b.T, first, axis=1), DECIMALS) + 0.0
                if not same:
                    best[own[here][:, None] == ids[None, :]] = -np.inf
                least = np.partition(best, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else np.full((len(here), 1), -np.inf)
                rows, cols = np.nonzero((best >= least) & (best > -np.inf))  # with all that tie for the last place
                order = np.lexsort((ids[cols], -best[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                parts.append((own[here[rows[keep]]], ids[cols[keep]], best[rows[keep], cols[keep]]))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("q_id", "b_id", "score"), columns)))

    return run


def nearest(queries: DataFrame, base: DataFrame, k: int, same: bool = False) -> DataFrame:
    """``q_id, b_id, score, rank``: each query's k items of the highest cosine, that of an item's best vector.

    queries, base: ``id long, vec``; several rows of an id in base are one item's vectors, those of a query its own, of
    which the best counts too.  An item of the query's own id is left out unless same.  Ties go to the smaller id; cosines
    are ranked by DECIMALS decimals; a zero vector has 0.  Null ids, vectors and components take no part, and only vectors
    of equal length meet.  A task holds one block of queries and one of items, and gives k rows a query.
    """
    good = "id is not null and vec is not null and not exists(vec, x -> x is null)"
    q, b = (df.where(good).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("d")) for df in (queries, base))
    n_q, n_b = max(1, -(-q.count() // QUERIES)), max(1, -(-b.count() // ITEMS))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")  # noqa: E731  all vectors of an id in one block
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "vec", "d", block(n_q).alias("qb"), every(n_b).alias("bb")).groupBy("qb", "bb", "d")
    right = b.select("id", "vec", "d", block(n_b).alias("bb"), every(n_q).alias("qb")).groupBy("qb", "bb", "d")
    found = left.cogroup(right).applyInArrow(_nearest(k, same), "q_id long, b_id long, score double")
    best = found.groupBy("q_id", "b_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "b_id"))).where(F.col("rank") <= k)
