"""Token budgets of live sessions: counters in the state store, and a timer for the time rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltspark.operators.sessions import est_tokens

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Budget(StatefulProcessor):
    """A session's tokens and messages since its last revision, when that was, and a timer for when the next one is due."""

    def __init__(self, most_tokens: int, most_messages: int, gap_us: int):
        self.most_tokens, self.most_messages, self.gap_us = most_tokens, most_messages, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "tokens long, n long, since long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat([r[["us", "t"]] for r in rows]).sort_values(["us", "t"])
        had = self.counters.get() if self.counters.exists() else None
        tokens, n, since = had or (0, 0, int(batch["us"].iloc[0]))
        out = []
        for us, t in zip(batch["us"].tolist(), batch["t"].tolist()):
            tokens, n = tokens + t, n + 1
            reason = "tokens" if tokens > self.most_tokens else "messages" if n > self.most_messages else "time" if us - since > self.gap_us else None
            if reason:
                out.append((key[0], us, tokens, n, reason))
                tokens, n, since = 0, 0, us
        if had is None or had[2] != since:
            if had is not None:
                self.handle.deleteTimer(self._due(had[2]))
            self.handle.registerTimer(self._due(since))
        self.counters.update((tokens, n, since))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        tokens, n, since = self.counters.get() if self.counters.exists() else (0, 0, 0)
        self.counters.clear()  # a session that stays quiet keeps no state
        yield self._frame([(key[0], since + self.gap_us, tokens, n, "time")] if n else [])

    def close(self) -> None:
        pass

    def _due(self, since: int) -> int:
        """In milliseconds, as timers are."""
        return (since + self.gap_us) // 1000 + 1

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "us", "tokens", "n", "reason"])


def budget_stream(messages: DataFrame, most_tokens: int = 64_000, trim: float = 0.3, most_messages: int = 100, gap_s: int = 300, late: str = "1 hour") -> DataFrame:
    """session_id, ts, tokens, n, reason: where a session's history needs revising; its counters then begin anew.

    messages: ``session_id, ts, content``.  A message revises if its session's tokens pass most_tokens * (1 - trim), its
    messages pass most_messages, or more than gap_s seconds have gone by since the last revision (or the first message).
    A session whose messages wait for a revision when the watermark passes that time is revised by a timer, at the time when
    it was due; one without any is forgotten.  Messages later than the watermark (late), or without a time, are left out.  The state is three
    numbers a session, in the RocksDB store, which this sets for the session; a micro-batch's rows of a session are taken
    in the order of their times.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # the first watermark is 1970, and what isn't after it would be late
    clock = F.greatest("ts", F.timestamp_millis(F.lit(1)))
    sized = messages.where("ts is not null").withColumn("clock", clock).withWatermark("clock", late).select("session_id", "clock", F.unix_micros("ts").alias("us"), F.coalesce(est_tokens(F.col("content")), F.lit(0)).cast("long").alias("t"))
    kind = messages.schema["session_id"].dataType.simpleString()
    revised = sized.groupBy("session_id").transformWithStateInPandas(
        Budget(int(most_tokens * (1 - trim)), most_messages, gap_s * 1_000_000), f"session_id {kind}, us long, tokens long, n long, reason string", "append", "EventTime"
    )
    return revised.select("session_id", F.timestamp_micros("us").alias("ts"), "tokens", "n", "reason")
