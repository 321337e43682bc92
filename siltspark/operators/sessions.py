"""Sessions, memory curation, call metrics and version histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How transient messages begin, English and Chinese.
TRANSIENT = (
    "what", "how", "when", "where", "who", "why", "can you", "could you", "will you", "would you", "hello", "hi ", "hey", "good morning", "good afternoon",
    "thanks", "thank you", "ok", "okay", "yes", "no", "yep", "nope", "什么", "怎么", "为什么", "你好", "谢谢", "可以", "能不能", "能否",
)


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def scope(messages: DataFrame, user: int | None = None, session: int | None = None) -> DataFrame:
    if user is not None:
        messages = messages.where(F.col("user_id") == user)
    return messages if session is None else messages.where(F.col("session_id") == session)


def est_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncate_mid(text: Column, n: int) -> Column:
    """The first and last half, with a mark of what is left out between them."""
    half = n // 2
    cut = F.concat(F.substring(text, 1, half), F.lit("\n[")) , F.concat((F.length(text) - 2 * half).cast("string"), F.lit(" characters truncated]\n"), F.right(text, F.lit(half)))
    return F.when(F.length(text) > n, F.concat(*cut)).otherwise(text)


def is_transient(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return (F.length(t) < 20) | F.greatest(*[t.startswith(p) for p in TRANSIENT])


def newest(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def recent(df: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """The newest n rows of each key, newest first."""
    return newest(df, key, order, n).orderBy(key, F.desc(order))


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", key).withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy(order))).where("_r = 1").drop("_r", "_k")


def session_stats(messages: DataFrame) -> DataFrame:
    spoken = F.col("role").isin("user", "assistant")
    n = F.count_if(spoken)
    chars = F.sum(F.when(spoken, F.length("content")).otherwise(0))
    return messages.groupBy("session_id").agg(
        F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_if(F.col("role") == "tool").alias("n_tool"),
        chars.alias("total_chars"), F.floor(F.coalesce(F.try_divide(chars, n), F.lit(0))).alias("avg_chars"),
    )


def compact_history(messages: DataFrame, least: int = 10) -> DataFrame:
    """Short sessions whole; of others the newest half, and one row that sums up the older half."""
    w = W.partitionBy("session_id")
    m = messages.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("turn"))})
    old = (F.col("n") > least) & (F.col("r") <= F.floor(F.col("n") / 2))
    kept = m.where(~old).select("session_id", "turn", "role", "content")
    summed = m.where(old).groupBy("session_id").agg(F.count("*").alias("c"), F.sum(est_tokens(F.col("content"))).alias("t"))
    summary = summed.select("session_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.concat(F.col("c").cast("string"), F.lit(" messages, ~"), F.col("t").cast("string"), F.lit(" tokens")).alias("content"))
    return kept.unionByName(summary)


def within_budget(messages: DataFrame, most: int, trim: float = 0.3) -> DataFrame:
    """Running tokens and whether the history needs revising at each message."""
    w = W.partitionBy("session_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    running = F.sum(est_tokens(F.col("content"))).over(w)
    out = messages.select("session_id", "turn", running.alias("tokens"), F.count("*").over(w).alias("n"))
    return out.withColumn("revise", (F.col("tokens") > most * (1 - trim)) | (F.col("n") > 100)).drop("n")


def message_texts(messages: DataFrame, most: int = 8000, rerank: int = 500) -> DataFrame:
    """``session_id, turn, text, rerank``: the beginnings of a message that are embedded and ranked anew."""
    return messages.select("session_id", "turn", F.left("content", F.lit(most)).alias("text"), F.left("content", F.lit(rerank)).alias("rerank"))


def merge_text(messages: DataFrame, most_tokens: int, title: str | None = None) -> DataFrame:
    """Each session's parts in order as one text, new text cut at most_tokens * 4 characters.

    Parts without text are left out; with title, a column, a part with one begins with ``## title``.  Parts beyond
    the cut are dropped by a running length before a session is gathered.
    """
    part = F.col("content")
    if title:
        part = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.lit("## "), F.col(title), F.lit("\n"), part)).otherwise(part)
    before = F.sum(F.length("content") + 2).over(W.partitionBy("session_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    messages = messages.where("content <> ''").select("session_id", "turn", part.alias("content")).withColumn("_at", F.coalesce(before, F.lit(0)))
    messages = messages.where(F.col("_at") <= most_tokens * 4 + 2)
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n\n")
    return messages.groupBy("session_id").agg(parts.alias("t")).select("session_id", F.when(F.length("t") > most_tokens * 4, F.concat(F.substring("t", 1, most_tokens * 4), F.lit("..."))).otherwise(F.col("t")).alias("merged"))


def evict(memories: DataFrame, most: int, ttl_days: int, now: str) -> DataFrame:
    """What stays: up to 80 % of most only expired ones go; above it, the top 60 % of most by importance."""
    moment = F.lit(now).cast("timestamp")
    age = (F.unix_seconds(moment) - F.unix_seconds("updated_at")) / 86400.0
    recency = F.greatest(F.lit(0.0), 1 - age / max(365, ttl_days))
    m = memories.withColumns({"n": F.count("*").over(W.partitionBy("user_id")), "importance": F.round(0.7 * recency + 0.3 * F.least(F.length("memory") / 500.0, F.lit(1.0)), 6)})
    m = m.where(age <= ttl_days)
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("importance"), "memory_id"))
    return m.withColumn("r", r).where((F.col("n") <= 0.8 * most) | (F.col("r") <= 0.6 * most)).select("memory_id", "user_id", "importance")


def call_metrics(calls: DataFrame) -> DataFrame:
    """Per name: calls, successes, errors, durations and the last call's error, cleared by a success."""
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    return calls.groupBy("name").agg(
        F.count("*").alias("calls"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("errors"), F.round(F.sum("duration_ms"), 2).alias("total_ms"),
        F.round(last("duration_ms"), 4).alias("last_ms"), last(F.when(F.col("success"), "").otherwise("error")).alias("last_error"), F.max("ts").cast("string").alias("last_call"),
    )


def latency_stats(df: DataFrame, key: str, value: str, buckets: int = 1024) -> DataFrame:
    """n, min, max, mean, the element n/2 of the sorted list as median, population deviation; nulls sort first.

    Values are counted by ranges, and only the range that holds a key's median is sorted, so that a key of very many
    rows is no task of its own.
    """
    d = df.select(key, F.col(value).alias("v"))
    whole = d.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"))
    bounds = whole.select(F.col(key).alias("k"), "lo", "hi", "n")
    bounds = F.broadcast(bounds) if bounds.limit(10_001).count() <= 10_000 else bounds
    share = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    part = F.when(F.col("v").isNull(), -1).otherwise(F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets)), F.lit(0)))
    placed = d.join(bounds, F.col(key).eqNullSafe(F.col("k"))).select(key, "v", "n", part.alias("part"))
    before = F.sum("c").over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counted = placed.groupBy(key, "part", "n").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(before, F.lit(0)))
    at = F.floor(F.col("n") / 2) - F.col("before")
    held = counted.where((at >= 0) & (at < F.col("c"))).select(F.col(key).alias("k"), F.col("part").alias("p"), (at + 1).alias("at"))
    row = F.row_number().over(W.partitionBy(key, "part").orderBy("v"))
    median = placed.join(held, F.col(key).eqNullSafe(F.col("k")) & (F.col("part") == F.col("p"))).withColumn("r", row).where(F.col("r") == F.col("at"))
    out = whole.join(median.select("k", F.col("v").alias("median")), F.col(key).eqNullSafe(F.col("k")), "left")
    return out.select(key, "n", *[F.round(c, 4).alias(name) for c, name in (("lo", "min"), ("hi", "max"), ("mean", "mean"), ("median", "median"), ("dev", "stddev"))])


def _by_span(history: DataFrame, span_us: int) -> DataFrame:
    """Each row in its span of time and, as what came before, in the next: a window over (name, _b) sees a whole span back.

    So a name with very many rows is spread over its spans; rows with ``_own`` are the results.
    """
    at = F.floor(F.col("us") / span_us)
    spread = F.explode(F.array(F.struct(at.alias("_b"), F.lit(True).alias("_own")), F.struct((at + 1).alias("_b"), F.lit(False).alias("_own"))))
    return history.withColumn("us", F.unix_micros("ts")).select("event_id", "name", "us", spread.alias("_x")).select("event_id", "name", "us", "_x.*")


def rolling_count(history: DataFrame, hours: int, limit: int) -> DataFrame:
    """Applied rows of a name in the trailing hours, and whether one more is allowed.

    Of a span and the one before, those count that have come less those that have left by now: running sums, whose work doesn't grow
    with the rows in a frame.
    """
    span = hours * 3_600_000_000
    all_of = W.partitionBy("name", "_b")
    so_far = all_of.orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    # a row of the span before is there from the start, and leaves when it is a span old
    moved = _by_span(history.where("applied"), span).withColumn("us", F.when(F.col("_own"), F.col("us")).otherwise(F.col("us") + span))
    n = F.count_if(~F.col("_own")).over(all_of) + F.sum(F.when(F.col("_own"), 1).otherwise(-1)).over(so_far)
    h = moved.withColumn("n", n).where("_own")
    return h.select("event_id", "name", "n", (F.col("n") < limit).alias("allowed"))


def cooldown_ok(history: DataFrame, seconds: int) -> DataFrame:
    """Whether a row comes late enough after the name's previous one; one further back than a span is."""
    w = W.partitionBy("name", "_b").orderBy("us", "event_id")
    h = _by_span(history, max(seconds, 1) * 1_000_000).withColumn("gap", F.col("us") - F.lag("us").over(w)).where("_own")
    return h.select("event_id", "name", F.coalesce(F.col("gap") >= seconds * 1_000_000, F.lit(True)).alias("ok"))


def chain(links: DataFrame) -> DataFrame:
    """Records with their signature and the preceding record's, null for a name's first."""
    w = W.partitionBy("name").orderBy("ts", "event_id")
    signed = links.withColumn("signature", F.sha2(F.concat_ws("|", "name", F.col("event_id").cast("string")), 256))
    return signed.select("event_id", "name", "signature", F.lag("signature").over(w).alias("previous"))


def health_rollup(checks: DataFrame) -> DataFrame:
    """The worst status of all rows; unknown without rows."""
    worst = F.max(F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return checks.agg(worst.alias("w")).select(F.when(F.col("w") == 2, "unhealthy").when(F.col("w") == 1, "degraded").when(F.col("w") == 0, "healthy").otherwise("unknown").alias("status"))


def with_responses(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Every case with its response, null without one; of several responses to a case each is one."""
    return cases.join(responses.select("case_id", "response"), "case_id", "left")


def score_eval(cases: DataFrame, pattern: str, least: int, cased: bool = False) -> DataFrame:
    """Pattern, length and not-empty metrics of each response, and whether all pass; cased: the pattern's case counts."""
    r = F.coalesce(F.col("response"), F.lit(""))
    held = r.contains(pattern) if cased else F.lower(r).contains(pattern.lower())
    out = cases.select("case_id", held.cast("double").alias("pattern"), F.round(F.least(F.lit(1.0), F.length(r) / least), 4).alias("min_length"), (F.trim(r) != "").cast("double").alias("not_empty"))
    return out.withColumn("passed", (F.col("pattern") >= 1) & (F.col("min_length") >= 1) & (F.col("not_empty") >= 1))


def eval_summary(results: DataFrame) -> DataFrame:
    n = F.count("*")
    return results.agg(F.count_if("passed").alias("passed"), n.alias("total"), F.round(100.0 * F.count_if("passed") / F.greatest(n, F.lit(1)), 4).alias("percent"))


#: Words that are no keywords.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "to", "of", "in", "for", "on", "with", "at", "by", "this", "that", "it", "and", "or", "but", "not", "so")
#: Marks of an abstract question.
ABSTRACT = ("why", "how", "explain", "concept", "idea", "mean", "difference", "relation", "summary")


def last_n(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The newest n rows."""
    return df.orderBy(F.desc(order)).limit(n)


def apply_policy(calls: DataFrame, deny: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> DataFrame:
    """calls whose name isn't denied and, if any are listed, is allowed; * fits every name, case is ignored."""
    fits = lambda names: F.lit("*" in names) | F.lower("name").isin(*[n.lower() for n in names])
    calls = calls.where(~fits(deny)) if deny else calls
    return calls.where(fits(allow)) if allow else calls


def _fields(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def keywords(text: Column, k: int = 5) -> Column:
    """The first k distinct words of over two bytes that are no stop words."""
    return F.slice(F.array_distinct(F.filter(_fields(text), lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS))), 1, k)


def route(text: Column) -> Column:
    """hybrid for over ten words, vector for an abstract question, else lexical."""
    abstract = F.greatest(*[F.lower(text).contains(m) for m in ABSTRACT])
    return F.when(F.size(_fields(text)) > 10, "hybrid").when(abstract, "vector").otherwise("lexical")
