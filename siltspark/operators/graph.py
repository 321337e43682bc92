"""Graphs of triples from relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))


def relations(table: DataFrame, kind: str, key: str, links: dict[str, tuple[str, str]], properties: list[str]) -> DataFrame:
    """s, p, o of one table in one pass: links (column -> predicate, kind) and property columns."""
    out = [F.struct(F.lit(p).alias("p"), entity(k, c).alias("o")) for c, (p, k) in links.items()]
    out += [F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in properties]
    return table.select(entity(kind, key).alias("s"), F.inline(F.array(*out)))


def union(*triples: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, triples)


def graph_stats(triples: DataFrame) -> DataFrame:
    return triples.agg(F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"), F.count("*").alias("triples"))


def _joined(patterns: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The patterns in an order in which each shares a variable with one before it."""
    names = lambda p: {x for x in p if x.startswith("?")}
    left, out, known = list(patterns[1:]), list(patterns[:1]), set().union(*map(names, patterns[:1]))
    while left:
        at = next((p for p in left if names(p) & known), None)
        if at is None:
            raise ValueError(f"no variable joins {left[0]} to the other patterns")
        left.remove(at)
        out.append(at)
        known |= names(at)
    return out


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern; names that begin with ? are variables.

    Patterns are joined in an order in which each shares a variable with an earlier one; if there is none, an error says so.
    """
    out = None
    for pattern in _joined(patterns):
        rows, names = triples, {}
        for column, x in zip("spo", pattern):
            if not x.startswith("?"):
                rows = rows.where(F.col(column) == x)
            elif x[1:] in names:
                rows = rows.where(F.col(column) == F.col(names[x[1:]]))
            else:
                names[x[1:]] = column
        rows = rows.select(*[F.col(c).alias(n) for n, c in names.items()])
        shared = [n for n in names if out is not None and n in out.columns]
        out = rows if out is None else out.join(rows, shared)
    return out


def graph_context(triples: DataFrame, keywords: list[str], limit: int = 20) -> DataFrame:
    """The first triples, in order, whose object holds a keyword; none without keywords."""
    hit = reduce(Column.__or__, [F.lower("o").contains(k.lower()) for k in keywords], F.lit(False))
    return triples.where(hit).distinct().orderBy("s", "p", "o").limit(limit)
