"""What the corpus operators share: tables, row keys, shared work folder, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a side may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only in local mode (tests, a single machine), where the setting may be missing, is a local folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-silt-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/silt-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps reread it, whatever executors are lost."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that is no column of df, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def row_key(*columns: str) -> Column:
    """A 64-bit key that repeated rows share; never null."""
    return F.xxhash64(*[F.col(c) for c in columns])


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, one row at least."""
    at = batch.schema.get_field_index(text)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most_bytes:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield batch.slice(lo)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)
