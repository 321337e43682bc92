"""Near-duplicate documents by an LSH forest over MinHash signatures, with exact confirmation.

1. Each document's distinct 3-word shingles give a set digest and a MinHash signature.  Documents
   with equal sets are one class; a class goes on as one row.
2. Every tree of the forest sorts all classes by its own order of all the signature's values.  Each
   region has a depth of its own: the least number of first values that no more than REGION rows share.
   All rows of such a region are candidates, as are a row and its next NEIGHBOURS, which share the longest
   common prefixes, in whatever region.  The outer rows of each sorted partition meet those of the next in
   a step of their own.  Candidates whose signatures agree well enough form loose groups.
3. Inside a loose group all links are confirmed on full sets.  In a group beyond BLOCK classes every
   class first meets PIVOTS of them; what the pivot of most links is linked with is one component and
   need not meet itself.  The others are cut into blocks that meet each other and the blocks of that
   component, each pair in one task, so a group of near copies sends rows in proportion to its size.
   A task returns edges that connect what its links connect, never all its pairs.
4. Components over the confirmed edges give each document's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.llm.common import fresh, row_key, saved, slices, small, table, work_dir
from siltspark.llm.components import components, spanning
from siltspark.llm.words import distinct_per_row, hash_words, mix64, shingles

VALUES = 64
TREES = 12
NEIGHBOURS = 3
REGION = 16
BLOCK = 512
PIVOTS = 8
_SEEDS = np.random.default_rng(77).integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)
_ORDERS = np.array([np.random.default_rng(500 + t).permutation(VALUES) for t in range(TREES)])
_EDGES = "u long, v long, tree int, key binary"


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x VALUES of 16-bit MinHash values; rows must not be empty."""
    out = np.empty((len(offsets) - 1, VALUES), np.uint16)
    for k, seed in enumerate(_SEEDS):
        x = values * seed
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum.reduceat(x, offsets[:-1]) if len(values) else np.zeros(0, np.uint64)
        out[:, k] = (mix64(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            values, offsets = distinct_per_row(*shingles(*hash_words(part.column(2)), 3))
            n = np.diff(offsets)
            digest = np.zeros(len(n), np.uint64)
            sig: list[bytes | None] = [None] * len(n)
            full = np.flatnonzero(n)
            if len(full):
                starts = np.append(offsets[full], offsets[-1])
                mixed = mix64(values ^ np.uint64(0x1234567))
                digest[full] = mix64(np.add.reduceat(mixed, starts[:-1]) ^ np.bitwise_xor.reduceat(values, starts[:-1])) ^ n[full].astype(np.uint64)
                for i, s in zip(full, signatures(values, starts)):
                    sig[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(digest.view(np.int64)), pa.array(sig, pa.binary())],
                ["doc_id", "row_key", "n_shingles", "node", "sig"],
            )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per class and tree: the signature in the tree's order as a sort key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, VALUES)
        for t, order in enumerate(_ORDERS):
            key = sig[:, order].astype(">u2").tobytes()
            keys = [key[i : i + 2 * VALUES] for i in range(0, len(key), 2 * VALUES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(keys, pa.binary()), batch.column(0)], ["tree", "key", "node"])


def regions(tree: np.ndarray, sig: np.ndarray, most: int = REGION) -> np.ndarray:
    """A number for each of the sorted rows: those of one number share as many first values as needed for no more than most rows to do so.

    Rows of equal signatures stay together, however many they are.
    """
    n = len(tree)
    if n < 2:
        return np.zeros(n, np.int64)
    differ = sig[1:] != sig[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), sig.shape[1])
    shared[tree[1:] != tree[:-1]] = -1
    out, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for depth in range(1, sig.shape[1] + 1):
        run = np.concatenate([[0], np.cumsum(shared < depth)])
        settled = open_ & ((np.bincount(run)[run] <= most) | (depth == sig.shape[1]))
        out[settled] = depth * n + run[settled]
        open_ &= ~settled
        if not open_.any():
            break
    return out


def _neighbours(least: float):
    """Star edges between candidates in a tree's order; a run of rows is seen with the end of the last one.

    A partition's first and last NEIGHBOURS rows are given as well, as ``u, tree, key`` without v.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, begun = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, VALUES)
            if begun < NEIGHBOURS:
                yield border(*(x[: NEIGHBOURS - begun] for x in (tree, node, sig)))
                begun += len(node)
            if tail is not None:
                tree, node, sig = np.concatenate([tail[0], tree]), np.concatenate([tail[1], node]), np.vstack([tail[2], sig])
            u, v, region = [], [], regions(tree, sig)
            for step in range(1, min(REGION, len(node))):
                meet = region[step:] == region[:-step]
                if step <= NEIGHBOURS:
                    meet |= (tree[step:] == tree[:-step]) & (sig[step:, 0] == sig[:-step, 0])
                at = np.flatnonzero(meet)
                at = at[(sig[at] == sig[at + step]).mean(axis=1) >= least]
                u.append(node[at])
                v.append(node[at + step])
            tail = (tree[-REGION:], node[-REGION:], sig[-REGION:])
            if u:
                u, v = spanning(np.concatenate(u), np.concatenate(v))
                if len(u):
                    none = [pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *none], ["u", "v", "tree", "key"])
        if tail is not None:
            yield border(*(x[-NEIGHBOURS:] for x in tail))

    def border(tree: np.ndarray, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        keys = pa.array([s.tobytes() for s in sig], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(tree), keys], ["u", "v", "tree", "key"])

    return run


def neighbours(forest: DataFrame, least: float, parts: int, folder: str) -> DataFrame:
    """``u, v``: edges between rows next to one another in a tree, within partitions and over their borders."""
    ordered = forest.repartitionByRange(parts, "tree", "key").sortWithinPartitions("tree", "key", "node")
    found = saved(ordered.mapInArrow(_neighbours(least), _EDGES), folder, "near")
    # a few rows a partition, so one task takes them all
    borders = found.where("v is null").select("tree", "key", F.col("u").alias("node")).distinct().coalesce(1).sortWithinPartitions("tree", "key", "node")
    return found.union(borders.mapInArrow(_neighbours(least), _EDGES)).where("v is not null").select("u", "v")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 21):
            values, offsets = distinct_per_row(*shingles(*hash_words(part.column(1)), 3))
            packed = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(packed, pa.binary())], ["node", "grp", "size", "shingles"])


def links(sets: list[np.ndarray], percent: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with 100 * intersection >= percent * union, by full counts.

    first: only pairs of one of the first so many rows with another are wanted.  Shared shingles are
    counted in slices of columns, so memory is bounded by rows x slice.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), sizes)
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    shingle, row = shingle[order], row[order]
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    row, column = row[common], column[common]
    split = n if first is None else first
    both = np.zeros((split, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) > 0]))
        step = max(64, (1 << 24) // n)
        for lo in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, [lo, lo + step])
            m = np.zeros((n, min(step, int(column[-1]) + 1 - lo)), np.float32)
            m[row[a:b], column[a:b] - lo] = 1
            both += m[:split] @ m.T
    union = sizes[:split, None] + sizes[None, :] - both
    u, v = np.nonzero(100 * both.astype(np.int64) >= percent * union.astype(np.int64))
    keep = u < v
    return u[keep], v[keep]


def _confirmed(percent: int):
    """Edges that connect the links of one block, or between two blocks."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("node", "ascending")])
        node = t.column("node").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        side = t.column("side").to_numpy()
        u, v = links(sets, percent, int((side == 0).sum()) if side[-1] else None) if len(node) > 1 else (np.zeros(0, int),) * 2
        u, v = spanning(node[u], node[v])
        return pa.table({"u": u, "v": v})

    return run


def _stars(percent: int):
    """``grp, pivot, node``: a block's links with its group's pivots, which are its rows of side 0."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("node", "ascending")])
        node, pivots = t.column("node").to_numpy(), int((t.column("side").to_numpy() == 0).sum())
        u, v = links([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()], percent, pivots)
        keep = (v >= pivots) & (node[u] != node[v])
        return pa.table({"grp": np.full(int(keep.sum()), t.column("grp")[0].as_py(), np.int64), "pivot": node[u[keep]], "node": node[v[keep]]})

    return run


def star_links(sets: DataFrame, percent: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Links ``pivot, node`` with the pivots of groups beyond BLOCK; and ``node, settled, n_settled`` of those groups' rows.

    Pivots go to every block of their group: PIVOTS rows for BLOCK.
    """
    big = sets.where(F.col("size") > BLOCK)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("node"), "node"))
    chosen = small(big.select("grp", "node").withColumn("r", rank).where(F.col("r") <= PIVOTS).select("node"))
    pivots = big.join(chosen, "node").select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("side"), "node", "shingles")
    members = big.select("grp", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.lit(1).alias("side"), "node", "shingles")
    stars = saved(members.union(pivots).groupBy("grp", "block").applyInArrow(_stars(percent), "grp long, pivot long, node long"), folder, "stars")
    best = stars.groupBy("grp", "pivot").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"), (F.max("n") + 1).alias("n_settled"))
    best = saved(best, folder, "pivots")
    settled = stars.join(best.select("grp", "pivot"), ["grp", "pivot"]).select("node").union(best.select("pivot")).withColumn("settled", F.lit(True))
    fate = big.select("node", "grp").join(settled, "node", "left").join(best.select("grp", "n_settled"), "grp", "left")
    return stars.select("pivot", "node"), fate.select("node", "settled", "n_settled")


def meetings(sets: DataFrame, fate: DataFrame) -> DataFrame:
    """``grp, low, high, side, node, shingles``: the rows of every pair of blocks of a group that must meet.

    Blocks of rows that aren't settled come first and meet all blocks; those of settled rows meet only the former.
    """
    placed = sets.join(fate, "node", "left").withColumns({"settled": F.coalesce("settled", F.lit(False)), "n_settled": F.coalesce("n_settled", F.lit(0))})
    mine, theirs = F.ceil((F.col("size") - F.col("n_settled")) / BLOCK).cast("int"), F.ceil(F.col("n_settled") / BLOCK).cast("int")
    placed = placed.withColumns({"open": mine, "shut": theirs})
    spread = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("settled"), F.col("open") + spread(F.col("shut"))).otherwise(spread(F.col("open"))))
    last = F.col("open") + F.when(F.col("settled"), 0).otherwise(F.col("shut")) - 1
    met = placed.withColumn("other", F.explode(F.when(F.col("open") > 0, F.sequence(F.lit(0), last))))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    return met.select("grp", low, high, (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "shingles")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row: ``doc_id, row_key, n_shingles, component_id, kept``.

    docs: ``doc_id long, text string``.  Documents are linked if their shingle sets' intersection is
    at least percent hundredths of the union; component_id is the smallest doc_id reachable.  A
    document without words (null or empty text) has no shingles and is its own component, as is one
    without links.  Rows that repeat a doc_id with the same text are one document; a null doc_id never
    is a component's smallest, and its row is kept only if its component has no other id.
    """
    folder = work_dir(docs.sparkSession)
    docs = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    features = saved(docs.mapInArrow(_features, "doc_id long, row_key long, n_shingles long, node long, sig binary"), folder, "features")
    classes = features.where("n_shingles > 0").groupBy("node").agg(F.first("sig").alias("sig"), F.min("row_key").alias("row_key"))
    classes = saved(classes, folder, "classes")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    forest = classes.select("node", "sig").mapInArrow(_trees, "tree int, key binary, node long")
    # edges are written before components, so that no task needs two Python workers at once
    near = saved(neighbours(saved(forest, folder, "forest"), percent / 100 - 0.2, int(parts), folder), folder, "candidates")
    loose = components(near, folder + "/loose")
    loose = saved(loose.withColumnRenamed("component", "grp"), folder, "groups")
    size = loose.groupBy("grp").agg(F.count("*").alias("size"))
    member = loose.join(size, "grp").join(classes.select("node", "row_key"), "node")
    text = docs.select(F.col("row_key").alias("k"), "text")
    sets = text.join(member.select("node", F.col("row_key").alias("k"), "grp", "size"), "k").dropDuplicates(["node"])
    sets = saved(sets.select("node", "text", "grp", "size").mapInArrow(_sets, "node long, grp long, size long, shingles binary"), folder, "sets")
    stars, fate = star_links(sets, percent, folder)
    met = meetings(sets, saved(fate, folder, "fate"))
    edges = saved(met.groupBy("grp", "low", "high").applyInArrow(_confirmed(percent), "u long, v long"), folder, "confirmed").union(stars)
    label = components(edges, folder + "/linked")
    named = features.where("n_shingles > 0").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = saved(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), folder, "least")
    label = label.union(classes.select("node", F.col("node").alias("component")).join(label.select("node"), "node", "left_anti"))
    ids = label.join(least, "component").select("node", "component_id")
    out = features.drop("sig").join(ids, (features["node"] == ids["node"]) & (features["n_shingles"] > 0), "left").drop("node")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row_key", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs, all columns whatever their names, with one document of each group of near-duplicates."""
    row, key = fresh(docs, "_row"), fresh(docs, "_key")
    kept = near_duplicates(docs.select("doc_id", "text"), percent).where("kept").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(row, row_key("doc_id", "text")).join(kept, F.col(row) == F.col(key), "left_semi").drop(row)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS x
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT DISTINCT a AS doc_id, a AS to_id FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.to_id = e.a),
c AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
