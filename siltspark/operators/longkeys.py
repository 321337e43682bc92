"""Windows over keys of any length: ranges of rows in key order, and borders that carry from one range to the next.

Rows are written once as sorted ranges (a key with a third of all rows fills many of them), each range is worked on by
itself, and what a range hands on, one row a key in it, meets in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.sources.ranged import read_ranged, work_dir, write_segment


def _ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> DataFrame:
    path = work_dir(df.sparkSession)
    write_segment(df, path, (*keys, *order), 0, parts)
    return read_ranged(df.sparkSession, path).drop("segment")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return F.expr(" and ".join(["a.part = b.part", *[f"a.`{k}` <=> b.`{k}`" for k in keys]]))


def lag_over(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with the value of the row before in its key by order, null for a key's first; order is unique in a key."""
    rows = _ranges(df, keys, order, parts)
    inside = W.partitionBy("part", *keys).orderBy(*order)
    rows = rows.withColumns({name: F.lag(value).over(inside), "_no": F.row_number().over(inside)})
    last = rows.groupBy("part", *keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("last"))
    before = last.withColumn("carried", F.lag("last").over(W.partitionBy(*keys).orderBy("part"))).where("carried is not null")
    # one row for each key and range at most
    out = rows.alias("a").join(before.alias("b"), _same(rows, before, keys) & F.expr("a._no = 1"), "left")
    return out.select(*[F.col(f"a.{c}") for c in df.columns], F.coalesce(f"a.{name}", F.col("b.carried")[value]).alias(name))


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with running sums (name: column) of its key by order, the row's own value in it; nulls count 0, order is unique in a key."""
    rows = _ranges(df, keys, order, parts)
    inside = W.partitionBy("part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(F.coalesce(c, F.lit(0))).over(inside) for n, c in sums.items()})
    total = rows.groupBy("part", *keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = total.select("part", *keys, *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums]).where(" or ".join(f"_{n} is not null" for n in sums))
    out = rows.alias("a").join(before.alias("b"), _same(rows, before, keys), "left")
    return out.select(*[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"a.{n}") + F.coalesce(F.col(f"b._{n}"), F.lit(0))).alias(n) for n in sums])


def sign_chain(records: DataFrame, parts: int | None = None) -> DataFrame:
    """records ``event_id, name, ts`` with their signature and, as previous_hash, that of the record before of their name."""
    signed = records.select("event_id", "name", "ts", F.sha2(F.concat_ws("|", "name", F.col("event_id").cast("string")), 256).alias("signature"))
    return lag_over(signed, ["name"], ["ts", "event_id"], "signature", "previous_hash", parts)


def verify_chain(records: DataFrame, parts: int | None = None) -> DataFrame:
    """``event_id, name, unbroken``: whether a record names the signature of the one before it, and a name's first one names none.

    records: ``event_id, name, ts, signature, previous_hash``; an empty previous_hash is none, and a missing signature is
    named by none.  Where one record is missing or changed, the one after it is broken.
    """
    none = lambda c: F.nullif(c, F.lit(""))
    before = lag_over(records.select("event_id", "name", "ts", none(F.col("signature")).alias("signature"), none(F.col("previous_hash")).alias("named")), ["name"], ["ts", "event_id"], "signature", "previous", parts)
    return before.select("event_id", "name", "ts", F.col("named").eqNullSafe(F.col("previous")).alias("unbroken"))


def first_breaks(records: DataFrame, parts: int | None = None) -> DataFrame:
    """``name, records, broken, first_break``: how many records a chain has and breaks, and the event where it first does."""
    at = F.min_by(F.when(~F.col("unbroken"), F.col("event_id")), F.when(~F.col("unbroken"), F.struct("ts", "event_id")))
    return verify_chain(records, parts).groupBy("name").agg(F.count("*").alias("records"), F.count_if(~F.col("unbroken")).alias("broken"), at.alias("first_break"))
