"""Tables kept as segments of files, each file a range of sorted keys, with a manifest of the ranges.

A segment is one write: a directory for each range, and a manifest row for it (first and last key, rows).  Readers ask
the manifest first and open only the directories whose range meets what they want.  A segment without a manifest, left by
a writer that was stopped, is not seen, and the next write takes its number.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wanted keys up to which the manifest is asked; more of them meet most files anyhow, and all files are read.
WANTED = 10_000


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only in local mode, where it may be unset, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-ranged-")
    return f"{root.rstrip('/')}/ranged-{uuid.uuid4().hex}"


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """``segment, part, lo struct, hi struct, n`` of every file range; None before the first write."""
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def next_segment(spark: SparkSession, path: str) -> int:
    have = manifest(spark, path)
    last = have.agg(F.max("segment").alias("s")).first().s if have is not None else None
    return 0 if last is None else last + 1


def write_segment(df: DataFrame, path: str, keys: tuple[str, ...], segment: int | None = None, parts: int | None = None, merge: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Writes df as one segment sorted by keys, whose number it gives; parts: how many ranges, the session's shuffle partitions by default.

    df has no columns named segment or part.  merge: an aggregation by the keys (and others) to the same columns, done in
    the ranges without another shuffle.  Equal first keys that fill more than a range go on in the next one.
    """
    spark = df.sparkSession
    number = next_segment(spark, path) if segment is None else segment
    ranges = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    placed = df.repartitionByRange(ranges, *keys)
    placed = (merge(placed) if merge else placed).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *keys)
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{path}/rows/segment={number}")
    key = F.struct(*keys)
    rows = spark.read.schema(df.withColumn("part", F.lit(0)).schema).parquet(f"{path}/rows/segment={number}")
    # one row a range
    rows.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/segment={number}")
    return number


def read_ranged(spark: SparkSession, path: str, wanted: DataFrame | None = None, meets: Callable[[Column, Column], Column] | None = None, segments: list[int] | None = None) -> DataFrame:
    """The rows of the ranges that meet a row of wanted, with their segment and part; all rows without wanted.

    meets(lo, hi): whether a range of keys may hold what a row of wanted asks for.  A range may hold other keys too, so a
    caller filters or joins what it gets.  The driver gets two numbers a range, no keys.  segments: only these.
    """
    schema = spark.read.parquet(f"{path}/schema").withColumns({"segment": F.lit(0), "part": F.lit(0)}).schema
    have = manifest(spark, path)
    if have is None:
        return spark.createDataFrame([], schema)
    if segments is not None:
        have = have.where(F.col("segment").isin(segments))
    if wanted is not None and wanted.limit(WANTED + 1).count() <= WANTED:
        have = have.join(F.broadcast(wanted), meets(F.col("lo"), F.col("hi")), "left_semi")
    found = have.select("segment", "part").distinct().collect()
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/segment={s}/part={p}" for s, p in sorted(map(tuple, found))])
