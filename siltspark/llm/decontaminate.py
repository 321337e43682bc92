"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of a benchmark item is 13 consecutive words (a shorter item is one window).  A document
holds a window only if it holds every word of it, so the window's rarest word, by its count over all
documents, is the necessary prefix of a containment join.  Document words meet these prefix words;
position bounds and then an exact comparison of the whole window settle each candidate.

Windows of a measured size are broadcast.  Beyond it both sides shuffle by the prefix word: document
words that are no prefix word are dropped before if those fit a broadcast, and a word with a large share
of all occurrences is dealt out by salts, its windows to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.llm.common import BROADCAST_ROWS, ascii_lower, fresh, saved, table, work_dir

#: Bytes of text up to which a side of at most BROADCAST_ROWS rows, or a set of words, is broadcast.
BROADCAST_BYTES = 64 << 20
#: A word with more than this part of all occurrences of prefix words is hot; so fewer than this many words are.
HOT_PARTS = 10_000
SALTS = 64
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``window array<string>, items array<string>``: the distinct windows and the items that hold each; an item without an id has windows, but no name."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    each = w.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), size).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def prefix_index(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """windows with ``token``, their rarest word by occurrences in docs (ties: the smaller word), its offset, and ``seen``, those occurrences."""
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    tokens = docs.select(F.explode(words(F.col("text"))).alias("token"))
    if vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = tokens.join(F.broadcast(vocabulary), "token").groupBy("token").count()
    else:
        counts = tokens.groupBy("token").count().join(vocabulary, "token")
    placed = windows.select("window", "items", F.posexplode("window").alias("offset", "token")).join(counts, "token", "left")
    rarest = F.min_by(F.struct("token", "offset", "count"), F.struct(F.coalesce("count", F.lit(0)), "token", "offset"))
    return placed.groupBy("window").agg(rarest.alias("p"), F.first("items").alias("items")).select("p.token", "p.offset", "window", "items", F.coalesce("p.count", F.lit(0)).alias("seen"))


def _measure(df: DataFrame, text: Column) -> tuple[int, int]:
    """Rows, and bytes of text in them."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return r.n, r.b


def _by_broadcast(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """A row a document with n, and a row a hit with its span and items: one pass over the documents."""
    # an empty word, which no text has, stands for the document itself
    itself = tokens.sparkSession.range(1).select(
        F.lit("").alias("token"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items")
    )
    index = F.broadcast(index.drop("seen").unionByName(itself))
    rows = tokens.select("doc_id", "text_key", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    start, is_doc = F.col("pos") - F.col("offset"), F.col("pos") == 0
    occurs = is_doc | (
        (start >= 1) & (start + F.size("window") - 1 <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(1)), F.size("window")) == F.col("window"))
    )
    hits = rows.join(index, (F.col("word") == F.col("token")) & occurs)
    return hits.select(
        "doc_id", "text_key", F.when(is_doc, F.size("w")).alias("n"),
        F.when(~is_doc, F.struct(start.alias("s"), (start + F.size("window")).alias("e"))).alias("span"), F.when(~is_doc, F.col("items")).alias("items"),
    )


def _by_shuffle(tokens: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """As _by_broadcast, whatever the windows' number; a word takes along only the words that a window can reach."""
    rows = tokens.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "word")).withColumn("pos", F.col("pos") + 1)
    prefixes = index.groupBy("token").agg(F.max("seen").alias("seen"))
    total = prefixes.agg(F.sum("seen")).first()[0] or 0
    if _measure(prefixes, F.col("token"))[1] <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(prefixes.select(F.col("token").alias("word"))), "word", "left_semi")
    hot = prefixes.where(F.col("seen") * HOT_PARTS > total).select("token", F.lit(SALTS).alias("salts"))  # fewer than HOT_PARTS rows
    salts = F.coalesce("salts", F.lit(1))
    low = F.greatest(F.col("pos") - size + 1, F.lit(1))
    rows = rows.join(F.broadcast(hot.withColumnRenamed("token", "word")), "word", "left").select(
        "doc_id", "text_key", "pos", "word", low.alias("low"), F.size("w").alias("n_words"), F.slice("w", low, 2 * size - 1).alias("near"),
        F.pmod(F.xxhash64("doc_id", "text_key", "pos"), salts).cast("int").alias("salt"),
    )
    dealt = index.join(F.broadcast(hot), "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), salts - 1)))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 1) & (start + F.size("window") - 1 <= F.col("n_words"))
    same = F.slice("near", F.greatest(start - F.col("low") + 1, F.lit(1)), F.size("window")) == F.col("window")
    hits = rows.join(dealt, (F.col("word") == F.col("token")) & (F.col("salt") == F.col("part")) & fits & same)
    hits = hits.select("doc_id", "text_key", F.lit(None).cast("int").alias("n"), F.struct(start.alias("s"), (start + F.size("window")).alias("e")).alias("span"), "items")
    none = tokens.select("doc_id", "text_key", F.size("w").alias("n"), F.lit(None).cast(hits.schema["span"].dataType).alias("span"), F.lit(None).cast("array<string>").alias("items"))
    return hits.unionByName(none)


def contamination(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """Per document: ``doc_id, text_key, n_words, n_hit, hit_items array<string>, contaminated``.

    docs: ``doc_id, text``; items: ``item_id, text``.  A document word inside any occurrence of a
    window is hit; a document is contaminated if at least a twentieth of its words is.  Null and
    empty texts have no words and no hits.  Repeated rows are judged alike and all returned; text_key
    tells rows of one doc_id with other texts apart.  Without items nothing is hit.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    windows = item_windows(items, size)
    index = saved(prefix_index(windows, keyed), work_dir(docs.sparkSession), "windows")
    tokens = keyed.select("doc_id", "text_key", words(F.col("text")).alias("w"))
    n, n_bytes = _measure(index, F.concat(F.array_join("window", " "), F.array_join("items", " ")))
    hits = _by_broadcast(tokens, index) if n <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES else _by_shuffle(tokens, index, size)
    per_doc = hits.groupBy("doc_id", "text_key").agg(
        F.max("n").cast("long").alias("n_words"), F.count("n").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("hit_items"),
    )
    covered = F.expr(
        "aggregate(spans, struct(0L as n, 0 as upto), (a, x) -> struct(a.n + greatest(0, x.e - greatest(x.s, a.upto)) as n, greatest(a.upto, x.e) as upto), a -> a.n)"
    )
    out = per_doc.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.select("doc_id", "text_key", "n_words", "n_hit", "hit_items", "contaminated", each.alias("copy")).drop("copy")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """docs, all columns whatever their names, without the contaminated ones."""
    doc, key = fresh(docs, "_id"), fresh(docs, "_key")
    bad = contamination(docs, items, size).where("contaminated").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[doc]) & (F.xxhash64(docs["text"]) == bad[key]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of contamination() over all documents and benchmark items."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    joined = F.array_join(F.array_sort("hit_items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated"
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[s : s + 12], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, m, s, array_to_string(w[s : s + m - 1], ' ') AS win
       FROM (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT r, s, dw.m AS m, item FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
