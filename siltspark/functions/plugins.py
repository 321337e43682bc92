"""Functions that a user brings: embedders over batches of texts, and named metrics."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashed_terms(texts: Sequence[str], size: int = 64) -> list[np.ndarray]:
    """Unit vectors of word counts, a word's place and sign by its CRC-32; zero without words."""
    out = []
    for text in texts:
        v = np.zeros(size, np.float32)
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % size] += 1 if h & 0x10000 else -1
        norm = float(np.linalg.norm(v))
        out.append(v / norm if norm else v)
    return out


def embed(df: DataFrame, text: str, fn: Embedder = hashed_terms, batch: int = 256, name: str = "vec") -> DataFrame:
    """df with a vector for each text, by any function of a batch of texts.

    A batch for which the function fails, or gives another number of vectors, has null vectors: searches then go
    by their lexical part.  A null text has a null vector.  Texts travel as Arrow batches to the tasks' workers, where
    only a batch's texts and vectors are Python objects at once.
    """

    def vectors(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float32())
        for texts in arrays:
            known = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            done = 0
            for k in range(0, len(known), batch):
                end = int(known[k + batch]) if k + batch < len(known) else len(texts)
                some, done = texts.slice(done, end - done).to_pylist(), end
                part = [t for t in some if t is not None]
                try:
                    got = list(fn(part))
                except Exception:  # noqa: BLE001  whatever a user's model raises
                    got = []
                made = iter(got if len(got) == len(part) else [None] * len(part))
                out = [None if t is None else next(made) for t in some]
                yield pa.array([v if v is None else np.asarray(v, np.float32) for v in out], kind)
            if done < len(texts):
                yield pa.nulls(len(texts) - done, kind)
            if not len(texts):
                yield pa.array([], kind)

    return df.withColumn(name, F.arrow_udf(vectors, "array<float>")(F.col(text)))


def _contains(case: dict[str, Column]) -> Column:
    return F.lower(case["response"]).contains(F.lower(case["expected_pattern"])).cast("double")


def _length(case: dict[str, Column]) -> Column:
    return F.when(case["min_length"] <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.length(case["response"]) / case["min_length"]))


def _tools(case: dict[str, Column]) -> Column:
    met = F.filter(case["expected_tools"], lambda e: F.exists(case["tools"], lambda a: F.lower(a).contains(F.lower(e))))
    return F.when(F.size(case["expected_tools"]) == 0, 1.0).otherwise(F.size(met) / F.size(case["expected_tools"]))


#: Metrics by name: a function of a case's columns that gives a score from 0 to 1.
METRICS: dict[str, Callable[[dict[str, Column]], Column]] = {
    "response_contains_pattern": _contains, "response_min_length": _length, "tool_trajectory_match": _tools,
    "response_not_empty": lambda case: (F.trim(case["response"]) != "").cast("double"),
}


def register_metric(name: str, build: Callable[[dict[str, Column]], Column]) -> None:
    METRICS[name] = build


def score_metrics(cases: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """case_id, a column for each metric, and passed: whether all reach their least scores.

    A metric that nobody registered passes with 1.  Missing inputs count as empty: an empty pattern or list of tools scores 1.
    """
    has = lambda c, empty: F.coalesce(F.col(c), empty) if c in cases.columns else empty
    no_tools = F.array().cast("array<string>")
    case = {"response": has("response", F.lit("")), "expected_pattern": has("expected_pattern", F.lit("")), "min_length": has("min_length", F.lit(0)), "tools": has("tools", no_tools), "expected_tools": has("expected_tools", no_tools)}
    scores = {name: F.round(METRICS[name](case), 4) if name in METRICS else F.lit(1.0) for name in wanted}
    out = cases.select("case_id", *[c.alias(n) for n, c in scores.items()])
    met = F.lit(True)
    for name, least in wanted.items():
        met = met & (F.col(name) >= least)
    return out.withColumn("passed", met)
