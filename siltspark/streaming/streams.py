"""The continuous forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltspark.operators.facts import fact_kind
from siltspark.operators.sessions import is_transient, newest
from siltspark.streaming.budget import budget_stream  # noqa: F401  the others' companion


def frontier_stream(urls: DataFrame, key: str) -> DataFrame:
    """Each key only the first time it is seen, resumable from the query's checkpoint; all keys seen are its state, without a limit."""
    return urls.dropDuplicates([key])


def failure_windows(traces: DataFrame, length: str = "24 hours", step: str | None = None, late: str = "1 hour", limit: int = 10) -> DataFrame:
    """Failed traces by name and event-time window, and whether they reach the limit; rows later than the watermark are dropped."""
    window = F.window("ts", length, step) if step else F.window("ts", length)
    bad = F.expr("not (success and error_count = 0 and quality > 0.8)")
    # counted, not filtered: a filter would go below the watermark, and good traces would no longer close windows
    n = traces.withWatermark("ts", late).groupBy(window, "name").agg(F.count_if(bad).alias("n")).where("n > 0")
    return n.select(F.col("window.start").alias("start"), "name", "n", (F.col("n") >= limit).alias("limited"))


def metric_stream(calls: DataFrame) -> DataFrame:
    """Running call counters by name, with the latest call's duration and error, for update mode.

    State is one row a name and is kept for good, as the counters are of all time.
    """
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    return calls.groupBy("name").agg(
        F.count("*").alias("calls"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("errors"), F.sum("duration_ms").alias("total_ms"),
        last("duration_ms").alias("last_ms"), last(F.when(F.col("success"), "").otherwise("error")).alias("last_error"),
    )


def live_sessions(events: DataFrame, gap: str, late: str = "1 hour", most: int = 500) -> DataFrame:
    """Sessions of a user's events, closed after a gap, with how many events they have and the newest of them in order.

    A session's state is its events until it closes; the list that goes on has the newest most.
    """
    by_time = F.sort_array(F.collect_list(F.struct("ts", "event_id")))
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), by_time.alias("e"))
    newest = F.slice("e", F.greatest(F.size("e") - most + 1, F.lit(1)), F.lit(most))
    return out.select(F.col("session_window.start").alias("start"), "user_id", "n", F.transform(newest, lambda x: x["event_id"]).alias("events"))


def promote_stream(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """User turns that hold a preference, a decision or a note, with which, each text of a session once within the watermark."""
    kept = messages.withWatermark("ts", late).where((F.col("role") == "user") & ~is_transient(F.col("content"))).withColumn("kind", fact_kind(F.col("content"))).where("kind is not null")
    return kept.dropDuplicatesWithinWatermark(["session_id", "content"])


def ingest_messages(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to a log at path, a folder a batch, so that a batch which runs again replaces itself.

    Nothing stored is rewritten; `stored_messages` applies the limit of a session, `compact_messages` makes it good on disk.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_messages(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """The newest messages of each session of the log, each turn once, from the latest batch that holds it."""
    log = spark.read.parquet(path)
    once = log.withColumn("_r", F.row_number().over(W.partitionBy("session_id", "turn").orderBy(F.desc("batch")))).where("_r = 1").drop("_r", "batch")
    return newest(once, "session_id", "turn", most)


def compact_messages(spark: SparkSession, path: str, target: str, most: int = 200) -> None:
    """Writes what `stored_messages` gives as the first batch of a new log."""
    stored_messages(spark, path, most).write.mode("overwrite").parquet(f"{target}/batch=0")
