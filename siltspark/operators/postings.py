"""Stored full-text search: a postings table sorted by term, grown by segments, for one query or a table of queries.

A segment holds the postings of some documents (``term, key, tf, dl``), sorted by term over ranges of files, its
terms with their document counts, and last its totals: a segment without totals doesn't count.  A query opens only the files
whose range of terms meets one of its words.  Documents that come later are a segment more; compact() makes one of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.operators import search
from siltspark.sources.ranged import next_segment, read_ranged, work_dir, write_segment

#: Rows below which a saved table goes to every task; beyond it the same join shuffles.
BROADCAST_ROWS = 100_000


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count proves that it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def add_documents(docs: DataFrame, path: str, key: str, text: str, parts: int | None = None) -> int:
    """Indexes documents whose keys aren't in the index yet as a new segment, whose number it gives.

    A null text counts as a document without a length.  parts: ranges of files, the session's shuffle partitions by default.
    """
    sized = docs.select(F.col(key).alias("key"), search.tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    rows = sized.select("key", "dl", F.inline(_counted(F.col("w"))))
    return _store(docs.sparkSession, path, rows, sized.agg(F.count("*").alias("n_docs"), F.count("dl").alias("n_texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_terms")), parts)


def _counted(words: Column) -> Column:
    """``struct<term, tf>`` of each distinct word: the lengths of its runs in the sorted words, so that nothing is shuffled to count."""

    def runs(w: Column) -> Column:
        firsts = F.array_compact(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)))
        # a one-element array makes an array that each step looks into a value that is made once
        return F.transform(F.array(firsts), lambda f: F.transform(f, lambda at, k: F.struct(w[at].alias("term"), (F.coalesce(F.get(f, k + 1), F.size(w)) - at).cast("long").alias("tf"))))

    return F.flatten(F.flatten(F.transform(F.array(F.sort_array(words)), runs)))


def _store(spark: SparkSession, path: str, rows: DataFrame, totals: DataFrame, parts: int | None) -> int:
    number = next_segment(spark, f"{path}/postings")
    add_up = lambda placed: placed.groupBy("term", "key", "dl").agg(F.sum("tf").alias("tf")).select("term", "key", "tf", "dl")  # noqa: E731  rows of one key are in one range
    write_segment(rows.select("term", "key", "tf", "dl"), f"{path}/postings", ("term", "key"), number, parts, add_up)
    written = read_ranged(spark, f"{path}/postings", segments=[number])
    terms = written.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms.write.mode("overwrite").parquet(f"{path}/terms/segment={number}")
    totals.write.mode("overwrite").parquet(f"{path}/totals/segment={number}")
    return number


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``segment, n_docs, n_texts (not null), n_terms`` of the segments that count."""
    columns = "n_docs long, n_texts long, n_terms long, segment int"
    try:
        return spark.read.schema(columns).parquet(f"{path}/totals")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """One row ``n_docs, avg_dl``."""
    return totals(spark, path).agg(F.sum("n_docs").alias("n_docs"), F.try_divide(F.sum("n_terms"), F.sum("n_texts")).alias("avg_dl"))


def segments(spark: SparkSession, path: str) -> list[int]:
    return [r.segment for r in totals(spark, path).select("segment").distinct().collect()]


def stored_terms(spark: SparkSession, path: str) -> DataFrame:
    """``term, df, cf`` of all documents."""
    have = totals(spark, path).select("segment").distinct()
    terms = spark.read.schema("term string, df long, cf long, segment int").parquet(f"{path}/terms")
    return terms.join(F.broadcast(have), "segment", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _meets(lo: Column, hi: Column) -> Column:
    """Whether terms from lo to hi may hold a word or, of a prefix, a term that begins with it."""
    word = F.col("word")
    return (hi["term"] >= word) & (F.when(F.col("whole"), lo["term"]).otherwise(F.left(lo["term"], F.char_length(word))) <= word)


def postings_of(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """The postings in files that may hold terms for the words (``word, whole``); these hold other terms too."""
    return read_ranged(spark, f"{path}/postings", words.select("word", "whole").distinct(), _meets, segments(spark, path))


def stored_search(spark: SparkSession, path: str, query: str, k: int) -> DataFrame:
    """``key, score`` as bm25_search gives them for the documents of all segments."""
    asked = search.query_words(query)
    words = spark.createDataFrame(asked, "word string, whole boolean")
    term = F.col("term")
    wanted = F.lit(False)
    for w in asked:
        wanted = wanted | search.matches(term, *w)
    tf = postings_of(spark, path, words).where(wanted).withColumn("inside", F.lit(True))
    return search.ranked(tf, whole(spark, path), asked, "key", k)


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``query_id, key, score, rank``: for each query what stored_search gives, in one job.

    queries: ``query_id, text``, distinct ids.  keep: gives of candidates ``query_id, key`` those that may be found; all
    documents count for the weights.  A query's words meet the terms by way of the terms' prefixes, an equi-join.  Only
    queries all of whose words have terms are looked for, and only the postings of their terms move; documents with the word of a query that the fewest
    documents have are its candidates, which meet their postings by key.
    """
    folder = work_dir(spark)
    words = queries.select("query_id", F.inline(search.query_word_column(F.col("text"))))
    ids = _saved(words.select("word", "whole").distinct().withColumn("id", F.monotonically_increasing_id()), f"{folder}/words")
    lengths = ids.where("not whole").agg(F.collect_set(F.char_length("word")).alias("lengths"))  # one row, a number for each length of word
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.char_length("term")), lambda n: F.struct(F.left("term", n).alias("word"), F.lit(False).alias("whole")))
    spread = stored_terms(spark, path).crossJoin(F.broadcast(lengths)).select("term", "df", F.inline(F.concat(prefixes, F.array(F.struct(F.col("term").alias("word"), F.lit(True).alias("whole"))))))
    fitting = lambda of: spread.join(small(of), ["word", "whole"])
    reach = fitting(ids).groupBy("id").agg(F.sum("df").alias("reach"))
    per_query = words.join(ids, ["word", "whole"]).join(reach, "id", "left").groupBy("query_id").agg(
        F.count("*").alias("n_words"), F.count("reach").alias("known"), F.min_by("id", F.struct("reach", "id")).alias("rare"), F.collect_list("id").alias("ids"),
    )
    live = _saved(per_query.where("n_words = known").select("query_id", "n_words", "rare", "ids"), f"{folder}/live")
    asked = _saved(ids.join(live.select(F.explode("ids").alias("id")).distinct(), "id", "left_semi").select("word", "whole", "id"), f"{folder}/asked")
    terms = _saved(fitting(asked).groupBy("term", "df").agg(F.collect_list("id").alias("has")), f"{folder}/terms")
    # postings that can't be of a word, by the beginnings of the words, stay where they are
    start = asked.agg(F.min(F.char_length("word"))).first()[0] or 1
    begins = asked.select(F.left("word", F.lit(start)).alias("begins")).distinct()
    rows = postings_of(spark, path, asked).withColumn("begins", F.left("term", F.lit(start))).join(small(begins), "begins", "left_semi").drop("begins")
    weighed = rows.join(small(terms), "term").crossJoin(F.broadcast(whole(spark, path)))
    hits = _saved(weighed.select("key", "has", search.weight(*map(F.col, ("n_docs", "df", "tf", "dl", "avg_dl"))).alias("weight")), f"{folder}/hits")
    rare = live.select("query_id", F.col("rare").alias("id"))
    candidates = hits.select("key", F.explode("has").alias("id")).join(small(rare), "id").select("query_id", "key").distinct()
    if keep is not None:
        candidates = keep(candidates)
    both = candidates.join(small(live.select("query_id", "n_words", "ids")), "query_id").join(hits, "key").where(F.arrays_overlap("has", "ids"))
    scored = both.groupBy("query_id", "key", "n_words").agg(F.sum("weight").alias("score"), F.size(F.array_distinct(F.flatten(F.collect_set(F.array_intersect("has", "ids"))))).alias("found"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    good = scored.where("found = n_words").select("query_id", "key", F.round("score", 4).alias("score"))
    return good.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def compact(spark: SparkSession, path: str, target: str, parts: int | None = None) -> None:
    """Writes all documents of the index as one segment of a new one at target."""
    rows = read_ranged(spark, f"{path}/postings", segments=segments(spark, path)).drop("segment", "part")
    _store(spark, target, rows, totals(spark, path).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_texts", "n_terms")]), parts)
