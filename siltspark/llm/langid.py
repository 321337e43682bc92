"""Language identification in two steps: the language family, then one-versus-one linear SVMs in it.

Features are relative frequencies of hashed byte 1- to 3-grams of the text with A-Z lower-cased and
ASCII other than letters as space.  A linear model over them is a mean of per-gram weights, so whole
texts are scored by table look-ups.  The models are fitted on a bounded, deterministic sample of
labelled rows (``per_language``); every row is scored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.llm.common import crc_mod, map_batches, row_key, slices, table

#: Families of common languages.  A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
}
_BINS = 1 << 12
DIMS = 256 + 2 * _BINS
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_PIECE = 1 << 19
_LETTER = regex.compile(r"\p{L}")


def _grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams that end at each byte but the first two."""
    c = _CLEAN[b].astype(np.uint32)
    one, two, three = c[2:], c[1:-1], c[:-2]
    pair = one * np.uint32(2654435761) + two * np.uint32(40503)
    triple = pair ^ (three * np.uint32(2246822519))
    triple ^= triple >> np.uint32(15)
    triple *= np.uint32(3266489917)
    return one, np.uint32(256) + (pair >> np.uint32(20)), np.uint32(256 + _BINS) + (triple >> np.uint32(20))


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joined bytes of several texts, each behind two spaces, with the texts' numbers by byte runs."""
    joined, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), _PIECE):
            part = (b"  " if lo == 0 else t[lo - 2 : lo]) + t[lo : lo + _PIECE]
            if joined and size + len(part) > _PIECE:
                yield np.frombuffer(b"".join(joined), np.uint8), np.array(owners)
                joined, owners, size = [], [], 0
            joined.append(part)
            owners.append((i, len(part)))
            size += len(part)
    if joined:
        yield np.frombuffer(b"".join(joined), np.uint8), np.array(owners)


def mean_weights(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean gram weight of each text under each model; weights: models x DIMS."""
    out = np.zeros((len(texts), len(weights)))
    for data, owners in _pieces(texts):
        if len(data) < 3:
            continue
        grams = _grams(data)
        ends = np.cumsum(owners[:, 1])
        starts = ends - owners[:, 1]
        # the grams of a part are those that end past its two leading bytes
        lo, hi = starts, ends - 2
        for m, w in enumerate(weights):
            sums = np.concatenate([[0.0], np.cumsum(w[grams[0]] + w[grams[1]] + w[grams[2]], dtype=np.float64)])
            np.add.at(out[:, m], owners[:, 0], sums[hi] - sums[lo])
    return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def frequencies(text: bytes) -> np.ndarray:
    """The feature vector of one text; an empty text has none set."""
    x = np.zeros(DIMS, np.float32)
    for lo in range(0, len(text), _PIECE):
        b = np.frombuffer((b"  " if lo == 0 else text[lo - 2 : lo]) + text[lo : lo + _PIECE], np.uint8)
        for g in _grams(b):
            x += np.bincount(g, minlength=DIMS)
    return x / max(1, len(text))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 40) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of a linear SVM (squared hinge, dual coordinate descent); y is 1 or -1."""
    scale = 1.0 / (np.sqrt((x**2).mean(axis=0)) + 1e-4)
    z = np.hstack([x * scale / np.sqrt(x.shape[1]), np.ones((len(x), 1))]).astype(np.float64)
    k = z @ z.T
    alpha, margin = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            new = max(0.0, alpha[i] - (y[i] * margin[i] - 1 + alpha[i] / (2 * c)) / (k[i, i] + 1 / (2 * c)))
            if new != alpha[i]:
                margin += (new - alpha[i]) * y[i] * k[i]
                alpha[i] = new
    w = z.T @ (alpha * y)
    slope = 3.0 / max(0.5, float(np.median(np.abs(margin))))
    return (w[:-1] * scale / np.sqrt(x.shape[1])).astype(np.float32), float(w[-1]), slope


class Model:
    """Learned languages, their families and the linear models: one against the rest for each family, one for each pair inside."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, families: dict[str, tuple[str, ...]] = FAMILIES):
        self.languages = sorted(set(labels))
        known = {lang: f for f, members in families.items() for lang in members}
        family = {lang: known.get(lang, f"only {lang}") for lang in self.languages}
        self.families = [(f, [lang for lang in self.languages if family[lang] == f]) for f in sorted(set(family.values()))]
        of = np.array([family[lang] for lang in labels])
        fits = [fit_svm(x, np.where(of == f, 1.0, -1.0)) for f, _ in self.families] if len(self.families) > 1 else []
        self.pairs = [p for _, members in self.families for p in itertools.combinations(members, 2)]
        for a, b in self.pairs:
            rows = (labels == a) | (labels == b)
            fits.append(fit_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
        self.weights = np.array([w for w, _, _ in fits], np.float32).reshape(len(fits), DIMS)
        self.bias, self.slope = np.array([b for _, b, _ in fits]), np.array([s for _, _, s in fits])

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        p = 1 / (1 + np.exp(-np.clip((mean_weights(texts, self.weights) + self.bias) * self.slope, -30, 30)))
        f = len(self.families) if len(self.families) > 1 else 0
        share = p[:, :f] / np.maximum(p[:, :f].sum(axis=1, keepdims=True), 1e-12) if f else np.ones((n, 1))
        best = share.argmax(axis=1)
        out, score = np.empty(n, object), share.max(axis=1)
        for k, (_, members) in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            votes = np.zeros((len(rows), len(members)))
            for j, (a, b) in enumerate(self.pairs):
                if a in members:
                    q = p[rows, f + j]
                    votes[:, members.index(a)] += q
                    votes[:, members.index(b)] += 1 - q
            if len(members) > 1:
                votes /= len(members) - 1
                score[rows] *= votes.max(axis=1)
            else:
                votes[:] = 1
            out[rows] = np.array(members, object)[votes.argmax(axis=1)]
        return list(out), score


def fit(labelled: DataFrame, per_language: int = 300) -> Model:
    """The model of ``key, text, lang`` rows; per_language rows of each language at most are read by it, copies once."""
    labelled = labelled.where("lang is not null and text is not null")
    ids = labelled.select("key", "lang").distinct()
    picked = ids.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))).where(F.col("r") <= per_language)
    picked = labelled.select("key", "text", "lang").join(F.broadcast(picked.select("key", "lang")), ["key", "lang"]).dropDuplicates(["key", "lang"])

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = [frequencies(t.encode()).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

    rows = map_batches(picked.select("text", "lang"), features, "lang string, x binary").collect()
    rows = sorted((r.lang, bytes(r.x)) for r in rows)
    x = np.array([np.frombuffer(v, np.float32) for _, v in rows], np.float32).reshape(len(rows), DIMS)
    return Model(x, np.array([lang for lang, _ in rows], object))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``lang_pred string, score double``; ``und`` and 0 where the text is null or has no letter.

    Columns of docs with these two names are replaced.
    """
    plain = docs.drop("lang_pred", "score")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text, 1 << 22):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            lang, score = model.predict([(t or "").encode() for t in texts])
            has = [bool(t) and _LETTER.search(t) is not None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([x if h else "und" for x, h in zip(lang, has)], pa.string()), pa.array(np.where(has, score, 0.0))],
                [*part.schema.names, "lang_pred", "score"],
            )

    return map_batches(plain, run, plain.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learned from rows whose crc32(doc_id) mod 4 is not 2.

    A null doc_id has no remainder: the row is neither learned from nor held out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 4) == 2
    model = fit(docs.where(~held).select(row_key("doc_id", "text").alias("key"), "text", "lang"))
    docs = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")
