"""Reports over sessions, calls, crawls and versions: counts a key, totals of a table, look-ups with what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.operators import corpus


def session_list(messages: DataFrame) -> DataFrame:
    """Per session: its messages and its last turn."""
    return messages.groupBy("session_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


def list_sessions(messages: DataFrame, user: int, n: int = 50) -> DataFrame:
    """A user's session ids, the highest first, n at most."""
    return messages.where(F.col("user_id") == user).select("session_id").distinct().orderBy(F.desc("session_id")).limit(n)


def tool_usage(calls: DataFrame, session: str = "user_id") -> DataFrame:
    """Calls of each name in each session."""
    return calls.groupBy(session, "name").agg(F.count("*").alias("n"))


def needs_analysis(traces: DataFrame, quality: float = 0.8) -> DataFrame:
    """Traces but for those that succeeded without errors at a higher quality; unknown counts as not so."""
    fine = F.col("success") & (F.col("error_count") == 0) & (F.col("quality") > quality)
    return traces.where(~F.coalesce(fine, F.lit(False)))


def memory_health(memories: DataFrame, capacity: int) -> DataFrame:
    """Per user: memories, the oldest creation, the newest update, and how many there may be."""
    created = "created_at" if "created_at" in memories.columns else "updated_at"
    return memories.groupBy("user_id").agg(
        F.count("*").alias("total"), F.min(created).cast("string").alias("oldest"), F.max("updated_at").cast("string").alias("newest"), F.lit(capacity).alias("capacity")
    )


def throughput(df: DataFrame, key: str, units: str, seconds: str) -> DataFrame:
    """Per key: the sum of units over the sum of seconds; null where no time passed."""
    rate = F.try_divide(F.sum(units), F.sum(seconds))
    return df.groupBy(key).agg(F.round(rate, 4).alias("per_second"))


def federation_stats(log: DataFrame, late_ms: float) -> DataFrame:
    """Per name: registries, entries, mean latency, and entries later than late_ms for each registry."""
    n = F.countDistinct("user_id")
    late = F.count_if(F.col("duration_ms") > late_ms)
    return log.groupBy("name").agg(n.alias("registries"), F.count("*").alias("entries"), F.round(F.avg("duration_ms"), 4).alias("latency"), F.round(late / n, 4).alias("error_rate"))


def link_hosts(pages: DataFrame) -> DataFrame:
    """Per host: the links to it, and the pages that hold them."""
    links = corpus.extract_links(pages)
    return links.groupBy(corpus.host(F.col("target")).alias("host")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def crawl_stats(pages: DataFrame) -> DataFrame:
    """Totals of a crawl ``page_id, url, html, status``: pages ok and failed; of those ok, hosts, bytes, links, assets, copies and their bytes.

    A page failed with a status of 400 or more, or none, or without text.  No page ok gives zeros.
    """
    good = F.coalesce((F.col("status") < 400) & (F.trim("html") != ""), F.lit(False))
    ok = pages.where(good)
    parts = [
        (pages, F.count("*"), "pages"), (pages, F.count_if(~good), "failed"), (ok, F.countDistinct(corpus.host(F.col("url"))), "hosts"), (ok, F.sum(F.octet_length("html")), "bytes"),
        (corpus.extract_links(ok), F.count("*"), "links"), (corpus.all_refs(ok), F.count("*"), "assets"),
    ]
    copies = corpus.dedup_stats(ok.select(F.col("html").alias("text")))
    rows = [df.agg(total.cast("long").alias("n")).select(F.lit(name).alias("name"), "n") for df, total, name in parts]
    rows += [copies.select(F.lit(name).alias("name"), F.col(name).cast("long").alias("n")) for name in ("duplicates", "bytes_saved")]
    names = [name for *_, name in parts] + ["duplicates", "bytes_saved"]
    both = reduce(DataFrame.unionByName, rows)
    return both.agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in names])


def block_report(pages: DataFrame) -> DataFrame:
    """Per reason why a page ``url, status, html`` is blocked: events, and different URLs."""
    blocked = pages.select("url", corpus.block_reason(F.col("status"), F.col("html")).alias("reason")).where("reason is not null")
    return blocked.groupBy("reason").agg(F.count("*").alias("events"), F.countDistinct("url").alias("urls"))


def current_version(names: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """The highest version of each name, 0 without one."""
    top = versions.groupBy(key).agg(F.max(version).alias("_v"))
    return names.select(key).join(top, key, "left").select(key, F.coalesce("_v", F.lit(0)).alias("version"))


def version_at(versions: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Each key's n-th row (from 1) in that order; keys with fewer have none."""
    return versions.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_r") == n).drop("_r")


def version_lookup(names: DataFrame, versions: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``key, version, missing``: each name's n-th version, or null and missing."""
    found = version_at(versions, key, order, n).select(key, F.col(order).alias("version"))
    return names.select(key).distinct().join(found, key, "left").withColumn("missing", F.col("version").isNull())
