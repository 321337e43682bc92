"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

A document's whole sequences are cut off first.  The remainders of a group of documents (one batch
of a partition, bounded in rows and tokens) are dealt, longest first, to the sequence with the
lowest estimated cost, linear plus quadratic in its pieces' lengths, that has room; one that fits
nowhere is cut over the sequences with most room.  A group's capacity is its tokens exactly: full
sequences, and one of each power of two in the rest, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from siltspark.llm.common import table

CAPACITY = 2048
GROUP_ROWS = 4096
GROUP_TOKENS = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by a vocabulary file of ``tokenizers``.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, so an added token that stands in a text is
    one id.  Where the vocabulary's ids are its merges' ranks, ``tiktoken`` merges by the ranks of the same file, and takes
    texts apart at the same added tokens: the same ids in a third of the time.  A probe that holds every added token
    compares the two; else ``tokenizers`` is used.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.slow = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        letters = _byte_letters()
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in tokenizer.get_vocab().items() if all(c in letters for c in t) and t not in added}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.encode = lambda text: fast.encode_to_numpy(text, allowed_special="all")
        probe = " The quick brown fox's 1234567 jumped;\n\n  \u00e9t\u00e9 \u4e2d\u6587 tionation stra\u00dfe\t\r\n x"
        probe += "".join(f"{t}{t} {t}  a{t}\n {t.upper()}{t[:-1]}" for t in added)
        if not np.array_equal(self.encode(probe), self.slow(probe)):
            self.encode = self.slow


def deal(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = 1 / CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces ``(document, start, length, sequence, offset)`` and the number of sequences.

    lengths: tokens of each document.  The cost of a sequence is the sum of l + quadratic * l * l
    over its pieces.
    """
    pieces, n = [], 0
    rest = lengths % capacity
    for i in np.flatnonzero(lengths >= capacity):
        for k in range(int(lengths[i]) // capacity):
            pieces.append((int(i), k * capacity, capacity, n, 0))
            n += 1
    total = int(rest.sum())
    if not total:
        return pieces, n
    room = np.array([capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1], np.int64)
    size = room.copy()
    cost = np.zeros(len(room))

    def put(i: int, start: int, length: int, s: int) -> None:
        pieces.append((i, start, length, n + s, int(size[s] - room[s])))
        room[s] -= length
        cost[s] += length + quadratic * length * length

    for i in np.argsort(-rest, kind="stable"):
        length, start = int(rest[i]), int(lengths[i] - rest[i])
        if not length:
            break
        s = int(np.where(room >= length, cost, np.inf).argmin())
        if room[s] >= length:
            put(int(i), start, length, s)
            continue
        while length:
            s = int(room.argmax())
            take = min(length, int(room[s]))
            put(int(i), start, take, s)
            start, length = start + take, length - take
    return pieces, n + len(room)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document of ``doc_id, text``; see SCHEMA.

    vocabulary: path of a tokenizers file that every executor can open.  A null or empty text is the
    end id alone.  Repeated rows are packed again; an empty table has no pieces.  Sequence ids are
    unique over the result and need not be consecutive.  Equal costs go to the sequence of the lower number,
    equal lengths to the document that is read first.  A text of any length is encoded whole.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 38
        ids, tokens, size = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            lengths = np.array([len(t) for t in tokens], np.int64)
            pieces, n = deal(lengths, capacity)
            crc = [zlib.crc32(tokens[i][start : start + length].tobytes()) for i, start, length, _, _ in pieces]
            col = [np.array(x, np.int64) for x in zip(*pieces)]
            out = [pa.array([ids[i] for i in col[0]], pa.int64()), *map(pa.array, (col[1], col[2], np.array(crc, np.int64), lengths[col[0]], col[3] + sequence, col[4]))]
            sequence += n
            return pa.RecordBatch.from_arrays(out, [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids += part.column(0).to_pylist()
                for t in map(encoder.encode, [t or "" for t in part.column(1).to_pylist()]):
                    tokens.append(np.append(t, np.array([end_id], "<u4")))
                    size += len(t) + 1
                if len(ids) >= GROUP_ROWS or size >= GROUP_TOKENS:
                    yield packed()
                    ids, tokens, size = [], [], 0
        if ids:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
