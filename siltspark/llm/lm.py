"""Language-model scores by deleted interpolation of unigrams and bigrams.

P(w | h) = a * c(h, w) / c(h) + b * c(w) / N + c / (V + 1), with weights (a, b, c) that depend on
how often the context h occurs.  The weights are learned by expectation-maximisation on a held-out
fold of the training documents, each of whose tokens is deleted from the counts it is judged by.

Texts are cut into chunks of bounded size.  A chunk asks for the corpus counts of its distinct n-grams by
their hashed keys, together with its own training counts.  Keys lie in as many ranges as there are chunks,
and messages from every chunk to every range would be too many, so they travel by way of a grid: a chunk
sends to each coarse range of the keys, and a node of the grid, one coarse range of one group of chunks,
adds up what its chunks sent and asks the fine ranges of it; answers go back the same way.  Chunks, nodes
and fine ranges have about the same size, the messages are chunks times the root of chunks, and an n-gram
that is frequent meets at most one row a group.  No count table ever goes to one place.

Expectation-maximisation runs over counted cells: shares are rounded to quarters of log2, so that held-out
tokens of any number make a bounded table.  Scores use the exact shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.llm.common import crc_mod, saved, table, work_dir
from siltspark.llm.words import hash_words, mix64, packed, unpacked

CHUNK_BYTES = 9 << 20
#: The chance that a bigram shares its key with another one is about 2 to the power of minus this.
SPARE_BITS = 20
_END, _BEGIN = np.uint64(0xA5A5F00D), np.uint64(0x5EED5EED)
_NONE = -1000  # log2 of a share of 0
_U = np.uint64


class Chunk:
    """The tokens of some texts, their distinct n-grams, and where each token's n-grams are among them."""

    def __init__(self, texts: pa.Array, key_bits: int):
        words, offsets = hash_words(texts)
        n = len(offsets) - 1
        self.lengths = np.diff(offsets) + 1
        self.ends = np.cumsum(self.lengths)
        tokens = np.full(len(words) + n, _END)
        inside = np.ones(len(tokens), bool)
        inside[self.ends - 1] = False
        tokens[inside] = words
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        context[self.ends - self.lengths] = _BEGIN
        pairs = mix64(context * _U(0x9E3779B97F4A7C15) + tokens) >> _U(64 - key_bits)
        self.first = self.ends - self.lengths
        self.words, self.word_at = np.unique(tokens, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)

    def of_row(self, per_token: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each text."""
        return np.add.reduceat(per_token, self.first) if len(self.first) else per_token[:0]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each distinct word and pair occurs in the rows that train marks."""
        use = np.repeat(train, self.lengths)
        return tuple(np.bincount(at[use], minlength=len(keys)).astype(np.uint32) for at, keys in ((self.word_at, self.words), (self.pair_at, self.pairs)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.Table]]:
    """``(chunk id, fold, rows)``: rows of the held-out fold and others apart, of CHUNK_BYTES each.

    Both passes over the documents cut the same partitions of the same files, so they get the same
    chunks; the chunk's row count and text length are part of its id, and a chunk that gets no
    answer fails the job.
    """
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    held: dict[bool, tuple[list, list]] = {True: ([], [0]), False: ([], [0])}
    made = 0

    def cut(fold: bool) -> tuple[int, bool, pa.Table]:
        nonlocal made
        made += 1
        rows = pa.Table.from_batches(held[fold][0])
        print_ = (rows.num_rows * 1_000_003 + held[fold][1][0]) % (1 << 20)
        held[fold][0].clear()
        held[fold][1][0] = 0
        return (part << 34) + ((made % (1 << 14)) << 20) + print_, fold, rows

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            some = batch.slice(lo, 512)
            for fold in (True, False):
                rows = some.filter(pc.equal(some.column("fold"), fold))
                if rows.num_rows:
                    held[fold][0].append(rows)
                    held[fold][1][0] += int(pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0)
                    if held[fold][1][0] >= CHUNK_BYTES:
                        yield cut(fold)
    for fold in (True, False):
        if held[fold][0]:
            yield cut(fold)


def _range(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The range of each key, by its top bits; keys ascend, so do ranges."""
    return ((keys >> _U(bits - 32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _split(keys: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.diff(ranges, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(keys)]):
        yield int(ranges[lo]), slice(lo, hi)


def _requests(key_bits: int, coarse: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, fold, rows in _chunks(batches):
            c = Chunk(rows.column("text"), key_bits)
            out: list[tuple] = []
            group = int(mix64(np.array([chunk], np.uint64))[0] % _U(coarse))
            for kind, keys, counts, bits in zip((0, 1), (c.words, c.pairs), c.counts(rows.column("train").to_numpy()), (64, key_bits)):
                for r, some in _split(keys, _range(keys, bits, coarse)):
                    out.append((r, group, chunk, fold, kind, some.stop - some.start, packed(np.diff(keys[some], prepend=_U(0))), packed(counts[some])))
            for lo in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist([dict(zip(_REQUEST.names, x)) for x in out[lo : lo + 256]], _REQUEST)

    return run


_REQUEST = pa.schema([("coarse", pa.int32()), ("grp", pa.int32()), ("chunk", pa.int64()), ("fold", pa.bool_()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASKED = pa.schema([("range", pa.int64()), ("coarse", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOTAL = pa.schema([("coarse", pa.int32()), ("grp", pa.int32()), ("range", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("fold", pa.bool_()), ("range", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("counts", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int64': 'long', 'int32': 'int', 'bool': 'boolean'}).get(str(f.type), f.type)}" for f in schema)


def _of(t: pa.Table, kind: int) -> list[dict]:
    """The rows of one kind; those of the other aren't made Python objects beside them."""
    return t.filter(pc.equal(t.column("kind"), kind)).to_pylist()


def _keys(asked: list[dict]) -> np.ndarray:
    return np.concatenate([np.cumsum(unpacked(x["keys"], np.uint64, x["n"]), dtype=np.uint64) for x in asked])


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed 64-bit counts, and where each key is among them."""
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, counts)
    return distinct, total, at


def _node(key_bits: int, coarse: int, fine: int):
    """What a node of the grid asks of the fine ranges: its chunks' keys, each once, with their summed counts."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        for kind, bits in ((0, 64), (1, key_bits)):
            asked = _of(t, kind)
            if asked:
                keys, total, _ = _added(_keys(asked), np.concatenate([unpacked(x["counts"], np.uint32, x["n"]) for x in asked]))
                for r, some in _split(keys, _range(keys, bits, coarse * fine)):
                    out.append((r, asked[0]["coarse"], asked[0]["grp"], kind, some.stop - some.start, packed(np.diff(keys[some], prepend=_U(0))), packed(total[some])))
        return pa.Table.from_pylist([dict(zip(_ASKED.names, x)) for x in out], _ASKED)

    return run


def _totals(t: pa.Table) -> pa.Table:
    """The total counts of one fine range, for each node; types and tokens: of the range, on one row."""
    out = []
    for kind in (0, 1):
        asked = _of(t, kind)
        if not asked:
            continue
        _, total, at = _added(_keys(asked), np.concatenate([unpacked(x["counts"], np.int64, x["n"]) for x in asked]))
        lo = 0
        for k, x in enumerate(asked):
            sums = (int((total > 0).sum()), int(total.sum())) if k == 0 and kind == 0 else (0, 0)
            out.append((x["coarse"], x["grp"], x["range"], kind, x["n"], packed(total[at[lo : lo + x["n"]]]), *sums))
            lo += x["n"]
    return pa.Table.from_pylist([dict(zip(_TOTAL.names, x)) for x in out], _TOTAL)


def _answers(asked: pa.Table, totals: pa.Table) -> pa.Table:
    """What a node of the grid answers its chunks."""
    out = []
    for kind in (0, 1):
        mine = _of(asked, kind)
        if mine:
            keys = [_keys([x]) for x in mine]
            distinct = np.unique(np.concatenate(keys))
            total = np.concatenate([unpacked(x["counts"], np.int64, x["n"]) for x in sorted(_of(totals.select(["kind", "range", "n", "counts"]), kind), key=lambda x: x["range"])])
            for x, k in zip(mine, keys):
                out.append((x["chunk"], x["fold"], x["coarse"], kind, x["n"], packed(total[np.searchsorted(distinct, k)])))
    return pa.Table.from_pylist([dict(zip(_ANSWER.names, x)) for x in out], _ANSWER)


def _texts(fold_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, fold, rows in _chunks(batches):
            if fold or not fold_only:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(rows)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    return run


def _with_counts(texts: pa.Table, answers: pa.Table, key_bits: int) -> Iterator[tuple[pa.Table, Chunk, list[np.ndarray]]]:
    """Rows of a chunk, its tokens, and the corpus counts of its distinct words and pairs."""
    for blob in texts.column("rows").to_pylist():
        rows = pa.ipc.open_stream(blob).read_all()
        c = Chunk(rows.column("text"), key_bits)
        got = lambda kind: sorted(_of(answers, kind), key=lambda x: x["range"])
        counts = [np.concatenate([np.zeros(0, np.int64)] + [unpacked(x["counts"], np.int64, x["n"]) for x in got(kind)]) for kind in (0, 1)]
        if (len(counts[0]), len(counts[1])) != (len(c.words), len(c.pairs)):
            raise ValueError("a chunk of documents was cut in another way than before")
        yield rows, c, counts


def _token_counts(c: Chunk, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: counts of the pair, of the context, of the word.  The context of a first token occurs as often as texts end."""
    word = counts[0][c.word_at]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[c.first] = word[c.ends - 1]
    return counts[1][c.pair_at], context, word


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of log2 of its count."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Quarters of log2(n / of), rounded; _NONE for 0."""
    return np.where((n > 0) & (of > 0), np.round(4 * np.log2(np.maximum(n, 1) / np.maximum(of, 1))), _NONE).astype(np.int64)


def _cells(key_bits: int, total: int):
    """How many held-out tokens have which context bucket and which (rounded) shares, without themselves."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        cells, n = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
        for _, c, counts in _with_counts(texts, answers, key_bits):
            pair, context, word = (x - 1 for x in _token_counts(c, counts))
            cell, times = np.unique(np.stack([bucket(context), _share(pair, context), _share(word, np.full_like(word, max(1, total - 1)))], 1), axis=0, return_counts=True)
            cells.append(cell)
            n.append(times)
        cell = np.vstack(cells)
        return pa.table({"bucket": cell[:, 0], "two": cell[:, 1], "one": cell[:, 2], "n": np.concatenate(n)})

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], types: int, rounds: int = 200) -> np.ndarray:
    """Weights of bigram, unigram and uniform shares by context bucket (64 of them), by expectation-maximisation.

    cells: ``(bucket, bigram share, unigram share, tokens)``, shares as quarters of log2.  A bucket
    without held-out tokens takes the weights of the next lower one.
    """
    out = np.tile(np.array([0.0, 0.9, 0.1]), (64, 1))
    a = np.array(cells, np.float64).reshape(-1, 4)
    for b in range(64):
        x = a[a[:, 0] == b]
        if not len(x):
            out[b] = out[b - 1] if b else out[0]
            continue
        p = np.stack([np.where(x[:, k] <= _NONE, 0.0, 2.0 ** (x[:, k] / 4)) for k in (1, 2)] + [np.full(len(x), 1 / (types + 1))], 1)
        w = np.array([1 / 3, 1 / 3, 1 / 3]) if b else np.array([0, 0.5, 0.5])
        for _ in range(rounds):
            q = w * p
            q /= q.sum(axis=1, keepdims=True)
            new = (q * x[:, 3:]).sum(axis=0) / x[:, 3].sum()
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        out[b] = np.maximum(w, [0, 1e-9, 1e-9])
    return out


def _scores(key_bits: int, types: int, total: int, weights: np.ndarray):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for rows, c, counts in _with_counts(texts, answers, key_bits):
            pair, context, word = _token_counts(c, counts)
            w = weights[bucket(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, total) + w[:, 2] / (types + 1)
            base = np.log10((word + 1) / (total + types + 1))
            n_known = c.of_row((word > 0).astype(np.int64))
            out.append(pa.table({
                "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": c.lengths, "n_known": n_known,
                "train_tokens": np.full(len(n_known), total), "base_score": c.of_row(base), "score": c.of_row(np.log10(p)),
            }))
        return pa.concat_tables(out) if out else _SCORE.empty_table()

    return run


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    docs: ``doc_id long, text, train boolean, fold boolean, held_out boolean``: rows with train are
    counted, those of them with fold also set the mixture weights.  A null text is empty: its one
    token is the end.  Repeated rows are counted and scored each.  With nothing to learn from, both
    models are uniform over one word.  Null flags count as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), flag("train"), (flag("train") & flag("fold")).alias("fold"), flag("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    tokens = max(2, (size.b or 0) + size.n)  # at least as many as there are
    key_bits = min(64, max(40, int(np.ceil(np.log2(tokens))) + SPARE_BITS))
    coarse = int(np.ceil(np.sqrt(max(8, -(-tokens // CHUNK_BYTES)))))  # fine ranges of each coarse one, and groups of chunks, are as many
    folder = work_dir(docs.sparkSession)
    asked = saved(docs.mapInArrow(_requests(key_bits, coarse), _sql(_REQUEST)), folder, "asked")
    wanted = asked.groupBy("coarse", "grp").applyInArrow(_node(key_bits, coarse, coarse), _sql(_ASKED))
    totals = saved(wanted.groupBy("range").applyInArrow(_totals, _sql(_TOTAL)), folder, "totals")
    whole = totals.agg(F.sum("types"), F.sum("tokens")).first()
    types, total = whole[0] or 0, whole[1] or 0
    answers = asked.select("coarse", "grp", "chunk", "fold", "kind", "n", "keys").groupBy("coarse", "grp").cogroup(totals.select("coarse", "grp", "range", "kind", "n", "counts").groupBy("coarse", "grp"))
    answers = saved(answers.applyInArrow(_answers, _sql(_ANSWER)), folder, "answers")
    held = docs.mapInArrow(_texts(True), "chunk long, rows binary").groupBy("chunk").cogroup(answers.where("fold").groupBy("chunk"))
    cells = held.applyInArrow(_cells(key_bits, total), "bucket long, two long, one long, n long")
    weights = learn_weights([tuple(r) for r in cells.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()], types)
    every = docs.mapInArrow(_texts(False), "chunk long, rows binary").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return every.applyInArrow(_scores(key_bits, types, total, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores; learned from those whose crc32(doc_id) mod 7 is not 2, weights from those where it is 3."""
    rest = crc_mod("doc_id", 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (rest != 2).alias("train"), (rest == 3).alias("fold"), (rest == 2).alias("held_out"))
    return lm_scores(docs)
