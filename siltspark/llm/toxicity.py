"""Toxicity by compression distance, with two zstandard dictionaries.

One dictionary is trained on toxic texts and one on ordinary texts, each behind a base that is trained
on other ordinary texts, so that the two differ in their own part only.  A window is WINDOW words of
running text, and its distance is its compressed length with the ordinary dictionary less that with
the toxic one.  Most of a toxic text is ordinary too, so the toxic dictionary is trained in rounds: each
half of the toxic texts is measured with a dictionary of the other half, and the windows of the largest
distance, which hold what toxic texts have in common, are what the next dictionaries are trained on.

A document's windows give a histogram of distances; a logistic model, fitted on labelled texts that the
dictionaries were not trained on, calibrates how many windows beyond which distance make which score.
Of FOLDS such splits the one of the least loss is kept.  Dictionaries and calibration come from a bounded
sample of labelled rows (``per_label``).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.llm.common import crc_mod, map_batches, row_key, slices, table

WINDOW = 4
STEPS = np.arange(1, 10)
FOLDS = 3
BASE_BYTES = 60_000
#: Bytes of the dictionaries' own parts, round by round, and the share of windows that go on to the next round.
ROUNDS = ((6000, 0.03), (3000, 0.0))
#: At most so many ordinary windows train a dictionary.
ORDINARY_WINDOWS = 20_000
_LEVEL = 15
_LEAST_PIECES = 400


def trained(pieces: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of exactly so many bytes, of segments of about that length; few pieces are repeated."""
    pieces = [p for p in pieces if len(p) >= 8] or [b"%d" % i * 8 for i in range(_LEAST_PIECES)]
    pieces = pieces * -(-_LEAST_PIECES // len(pieces))
    return zstandard.train_dictionary(size, pieces, k=segment, d=8).as_bytes().ljust(size, b"\0")[:size]


def windows(text: bytes, step: int = WINDOW) -> list[bytes]:
    """Runs of WINDOW words, begun at every step; a shorter text is one."""
    words = text.split()
    return [b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, max(1, len(words) - WINDOW + step), step)] if words else []


class Distance:
    """Compressed length of windows under the ordinary dictionary less that under the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.parts = (toxic, ordinary)
        self.toxic, self.ordinary = (self._compressor(x).compress for x in self.parts)

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
        d.precompute_compress(level=_LEVEL)
        return zstandard.ZstdCompressor(level=_LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __reduce__(self):
        return Distance, self.parts

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows], np.int64)


def train(toxic: list[bytes], ordinary: list[bytes]) -> Distance:
    """The two dictionaries of lower-cased toxic and ordinary texts."""
    shuffle = random.Random(11)
    base_pieces, own = ([w for t in ordinary[k::2] for w in windows(t)] for k in (0, 1))
    for x in (base_pieces, own):
        shuffle.shuffle(x)
    base = trained(base_pieces[:ORDINARY_WINDOWS], BASE_BYTES, 64)
    halves = [[w for t in toxic[k::2] for w in windows(t, 1)] for k in (0, 1)]
    chosen = [list(h) for h in halves]
    for size, share in ROUNDS:
        plain = base + trained(own[:ORDINARY_WINDOWS], size, 10)
        if not share:
            break
        new = []
        for h, other in zip(halves, reversed(chosen)):
            d = Distance(base + trained(other, size, 10), plain)(h)
            new.append([h[i] for i in np.argsort(-d, kind="stable")[: max(1, int(len(h) * share))]] if h else [])
        chosen = new
    return Distance(base + trained(chosen[0] + chosen[1], size, 10), plain)


def features(distance: Distance, texts: list[bytes]) -> np.ndarray:
    """Shares and counts of a text's windows by distance."""
    out = np.zeros((len(texts), 2 * len(STEPS) + 1))
    for i, t in enumerate(texts):
        w = windows(t)
        if w:
            d = np.bincount(np.clip(distance(w), 0, STEPS[-1]), minlength=STEPS[-1] + 1)
            over = np.cumsum(d[::-1])[::-1][1:]
            out[i, : len(STEPS)] = np.sqrt(over / len(w))
            out[i, len(STEPS) : -1] = np.log1p(over)
            out[i, -1] = np.log1p(len(w))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method on standardised columns."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / std, float(w[-1] - (w[:-1] * mean / std).sum())


class Model:
    """Dictionaries and calibration; without four labels of each kind nothing is learned and every score is 0.5 at most."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.prior = min(0.5, len(toxic) / max(1, len(toxic) + len(ordinary)))
        self.distance = None
        if len(toxic) < 4 or len(ordinary) < 4:
            return
        best = np.inf
        for fold in range(FOLDS):
            # a dictionary is only used with the calibration that was made for it, on texts it wasn't trained on
            d = train(*([t for i, t in enumerate(x) if i % FOLDS != fold] for x in (toxic, ordinary)))
            held = (toxic[fold::FOLDS], ordinary[fold::FOLDS])
            x, y = np.vstack([features(d, t) for t in held]), np.repeat([1.0, 0.0], [len(t) for t in held])
            weights, bias = fit_logistic(x, y)
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            loss = -float(np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
            if loss < best:
                best, self.weights, self.bias, self.distance = loss, weights, bias, d

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.distance is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(features(self.distance, texts) @ self.weights + self.bias, -30, 30)))


def fit(labelled: DataFrame, per_label: int = 1500) -> Model:
    """The model of ``key, text, toxic`` rows; per_label rows of each label at most are read by it, copies once.

    Rows with a null text or a label other than 0 and 1 are not learned from.
    """
    good = labelled.where("toxic in (0, 1) and text is not null")
    rank = F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("key"), "key"))
    picked = good.select("key", "toxic").distinct().withColumn("r", rank).where(F.col("r") <= per_label).select("key", "toxic")
    rows = good.select("key", "text", "toxic").join(F.broadcast(picked), ["key", "toxic"]).dropDuplicates(["key", "toxic"]).collect()
    rows = sorted((r.key, r.text, int(r.toxic)) for r in rows)
    of = lambda label: [r[1].lower().encode() for r in rows if r[2] == label]
    return Model(of(1), of(0))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score double``: the calibrated chance of label 1; a null text counts as empty, a column score of docs is replaced."""
    plain = docs.drop("score")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text, 1 << 22):
            texts = [(t or "").lower().encode() for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(texts))], [*part.schema.names, "score"])

    return map_batches(plain, run, plain.withColumn("score", F.lit(0.0)).schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> DataFrame:
    """``key, text, toxic`` of the sample of labelled documents; none whose crc32(doc_id) mod 3 is 1.

    The sample is chosen by keys alone; the texts of its rows, 2 * per_label keys at most, are then
    picked in a scan, so that no other text is shuffled.  Repeated documents are given once.
    """
    labels = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").distinct()
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text").where((crc_mod("doc_id", 3) != 1) & F.col("text").isNotNull())
    rank = F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("key"), "key"))
    ids = keyed.select("doc_id", "key").join(labels, "doc_id").select("key", "toxic").distinct().withColumn("r", rank)
    picked = ids.where(F.col("r") <= per_label).select("key", "toxic")
    return keyed.select("key", "text").join(F.broadcast(picked), "key").dropDuplicates(["key", "toxic"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; a null doc_id has no remainder and is never learned from or held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_rows(docs, table(spark, sf_dir, "labels")))
    docs = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return score(docs, model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
