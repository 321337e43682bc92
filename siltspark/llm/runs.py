"""Periodic runs of words, by the branching tandem test on an enhanced suffix array.

The suffix array of a batch of texts is sorted by prefix doubling; equal words have equal numbers, and a mark of its
own ends each text.  The LCP table follows from the same ranks, level by level downwards.  An LCP interval [lo, hi) of
depth d holds all suffixes that share their first d words; it is known by its borders in the table, and no tree node is
made.  A square of two times d words that can't move one word to the right branches: its suffixes i and i + d lie in
different children of an interval of depth d.  At most one child is larger than half of its interval; from each suffix i
of the others, the inverse array tells whether i + d or i - d lies in the interval.  Of a long enough run, the suffixes
d and 2 d before the square lie there too, so squares of shorter stretches end here.  What is left rotates to the left
as far as words agree, which gives the run; squares of a multiple of a run's period end where the run does, lie inside
it, and merge into it.

Work grows with n log n for a text of n words; texts are independent, so nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.llm.common import fresh, map_batches, slices, table

#: A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
SLICE_BYTES, CHUNK = 1 << 22, 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _starts(first: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it where first holds; it holds at 0."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def suffix_array(rows: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, rank, lcp)`` of all suffixes, row by row; lcp[r] is of the suffixes ranked r - 1 and r.

    symbols: each row's numbers, above 0, and a 0 at its end.  A suffix ends at its row's 0.
    """
    n = len(symbols)
    key = rows * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = _starts(first)
    single = first.copy()
    single[:-1] &= first[1:]
    live, h, levels = order[~single], 1, []
    while len(live):  # live: suffixes that share their first h words with others, by rank
        old = rank[live]
        levels.append((live.astype(np.int32), old))
        key = old * np.int64(n) + rank[live + h]
        o = np.argsort(key)
        key, live, old = key[o], live[o], old[o]
        first = np.ones(len(live), bool)
        first[1:] = key[1:] != key[:-1]
        group = first.copy()
        group[1:] = old[1:] != old[:-1]
        rank[live] = old + _starts(first) - _starts(group)
        single = first
        single[:-1] = first[:-1] & first[1:]
        live, h = live[~single], 2 * h
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    lcp, at = np.zeros(n, np.int32), rank.copy()
    for k in reversed(range(len(levels))):
        live, old = levels.pop()
        at[live] = old  # ranks by the first 2 ** k words
        r = rank[live]
        r = r[r > 0]
        seen = lcp[r]
        lcp[r] = seen + ((at[order[r - 1] + seen] == at[order[r] + seen]).astype(np.int32) << k)
    return order, rank, lcp


def _before(v: np.ndarray, todo: np.ndarray, strict: bool) -> np.ndarray:
    """For the places todo the last place before that has a smaller value (or an equal one, unless strict); v begins with its least value."""
    p = np.arange(-1, len(v) - 1)
    while len(todo):
        todo = todo[v[p[todo]] >= v[todo]] if strict else todo[v[p[todo]] > v[todo]]
        p[todo] = p[p[todo]]
    return p


def small_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(lo, hi, depth, start, end)``: the children of LCP intervals [lo, hi) that are at most half as large as these, and whose interval has LEAST_PERIODS suffixes."""
    n = len(lcp)
    v = np.append(lcp, 0)
    v[0] = 0
    back = v[::-1].copy()
    at = np.flatnonzero(v > 0)
    lo = _before(v, at, True)[at]
    hi = n - _before(back, n - at, True)[n - at]
    wide = hi - lo >= LEAST_PERIODS
    at, lo, hi = at[wide], lo[wide], hi[wide]
    nearest, following = _before(v, at, False)[at], n - _before(back, n - at, False)[n - at]
    depth, whole, first = v[at], hi - lo, nearest == lo
    right, left = 2 * (following - at) <= whole, first & (2 * (at - lo) <= whole)
    both = lambda x: np.concatenate([x[right], x[left]])
    return both(lo), both(hi), both(depth), np.concatenate([at[right], lo[left]]), np.concatenate([following[right], at[left]])


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` of the branching squares that end a stretch of LEAST_PERIODS periods or more."""
    lo, hi, depth, start, end = small_children(lcp)
    total = np.concatenate([[0], np.cumsum(end - start)])
    places, periods, a = [], [], 0
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, side="right")) - 1)
        size = end[a:b] - start[a:b]
        child = np.repeat(np.arange(a, b), size)
        i = order[np.arange(total[a], total[b]) - total[child] + start[child]].astype(np.int64)
        d = depth[child].astype(np.int64)
        for to, square in ((i + d, i), (i - d, i - d)):
            r = rank[np.maximum(to, 0)]
            found = np.flatnonzero((to >= 0) & (r >= lo[child]) & (r < hi[child]) & ((r < start[child]) | (r >= end[child])))
            s, p, c = square[found], d[found], child[found]
            for k in range(1, LEAST_PERIODS - 1):
                r = rank[np.maximum(s - k * p, 0)]
                keep = (s >= k * p) & (r >= lo[c]) & (r < hi[c])
                s, p, c = s[keep], p[keep], c[keep]
            places.append(s)
            periods.append(p)
        a = b
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(places), np.concatenate(periods)]), axis=1)
    return pairs[0], pairs[1]


def rotate(symbols: np.ndarray, place: int, period: int, least: int) -> int:
    """The first place, least or later, from which on the words up to place agree with those a period after them."""
    step = 64
    while place > least:
        lo = max(least, place - step)
        differ = np.flatnonzero(symbols[lo:place] != symbols[lo + period : place + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        place, step = lo, 4 * step
    return place


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Each text's runs ``(start, length, period)``, by start and period; texts are lists of words.

    A run is a stretch of max(LEAST_WORDS, LEAST_PERIODS * period) words or more with that smallest period, which no
    neighbouring word extends.
    """
    numbers: defaultdict = defaultdict(count(1).__next__)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not sizes.sum() - len(sizes):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.zeros(starts[-1], np.int64)
    for t, lo in zip(texts, starts.tolist()):
        symbols[lo : lo + len(t)] = np.fromiter(map(numbers.__getitem__, t), np.int64, len(t))
    rows = np.repeat(np.arange(len(texts)), sizes)
    places, periods = branching_squares(*suffix_array(rows, symbols))
    ends = places + 2 * periods
    by_end = np.lexsort((periods, ends))
    last, here = -1, []
    for place, period, end in zip(places[by_end].tolist(), periods[by_end].tolist(), ends[by_end].tolist()):
        if end != last:
            last, here = end, []
        if any(period % q == 0 and s <= place for s, q in here):
            continue
        row = int(rows[place])
        least = int(starts[row])
        s = rotate(symbols, place, period, least)
        here.append((s, period))
        if end - s >= max(LEAST_WORDS, LEAST_PERIODS * period):
            out[row].append((s - least, end - s, period))
    return [sorted(r) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a blank, of every run only its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``runs array<struct<start, length, period>>`` and ``collapsed string``, the words without repeated periods.

    Words are runs of other characters than ASCII white space, numbered from 0, and compared as they are.  A null or
    empty text, or one of white space, has no runs and collapses to an empty string.  Rows are independent: repeated rows
    get equal results, an empty table stays empty.  A word in several runs is dropped if any of them drops it.  Columns
    named runs or collapsed are replaced.  A text of any length is taken whole, with about 100 bytes of memory a word.
    """
    plain = docs.drop("runs", "collapsed")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = batch.schema.get_field_index(text)
        for part in slices(batch, text, SLICE_BYTES):
            texts = [(t or b"").split() for t in part.column(at).cast(pa.binary()).to_pylist()]
            found = find_runs(texts)
            clean = pa.array([collapse(t, r) for t, r in zip(texts, found)], pa.binary()).cast(pa.string())
            named = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], RUNS)
            yield pa.RecordBatch.from_arrays([*part.columns, named, clean], [*part.schema.names, "runs", "collapsed"])

    schema = plain.withColumns({"runs": F.expr("cast(null as array<struct<start: long, length: long, period: long>>)"), "collapsed": F.lit(None).cast("string")}).schema
    return map_batches(plain, run, schema)


def greatest_exponent(runs: str) -> Column:
    """The run of the greatest length / period, compared exactly; the first of several; null without runs."""
    return F.expr(f"aggregate({runs}, cast(null as struct<start: long, length: long, period: long>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")


def with_tails(docs: DataFrame) -> DataFrame:
    """docs whose texts are the contract's: every tenth id, by its checksum, has a tail of one repeated stretch; a null id has none."""
    h, w, n = fresh(docs, "_h"), fresh(docs, "_w"), fresh(docs, "_n")
    g = f"({h} div 10)"
    tail = f"array_join(transform({w}, (x, i) -> if(i < {g} % {n}, x, {w}[cast({g} % {n} + (i - {g} % {n}) % (1 + ({n} - {g} % {n}) div (3 + {g} % 8)) as int)])), ' ')"
    out = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    out = out.withColumn(w, F.when(F.col(h) % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn(n, F.size(w))
    return out.withColumn("text", F.when(F.col(n) > 0, F.expr(tail)).otherwise(F.col("text"))).drop(h, w, n)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of collapse_runs() over all documents, their tails added."""
    found = collapse_runs(with_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", greatest_exponent("runs"))
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
