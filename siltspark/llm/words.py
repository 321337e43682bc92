"""Word hashing over Arrow string columns.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``) of the text with
A-Z lower-cased.  A whole Arrow batch is hashed with NumPy, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_U = np.uint64
_BYTE_LOWER = np.arange(256, dtype=np.uint8)
_BYTE_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_CODE = np.random.default_rng(20240201).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE_CODE = _BYTE_CODE[_BYTE_LOWER]
_BASE = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(int(_BASE), 1 << 16)
_INVERSE = _powers(pow(int(_BASE), -1, 2**64), 1 << 16)
_WORD_CHUNK = len(_POWERS)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and row offsets of a string array; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: 64-bit hashes of all words, and where each row's words begin.

    Row i has ``hashes[offsets[i]:offsets[i + 1]]``; null and empty rows have none.
    """
    data, offsets = _buffers(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    # A word's hash is a polynomial over its bytes, from differences of running sums.  Sums are
    # taken over chunks of words; a chunk's bytes are addressed from its own first byte.
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + _WORD_CHUNK, side="right")))
        size = int(ends[hi - 1] - base)
        powers = _POWERS if size <= len(_POWERS) else _powers(int(_BASE), size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[base : base + size]] * powers[:size], out=sums[1:])
        at = starts[lo:hi] - base
        inverse = _INVERSE if size <= len(_INVERSE) else _powers(pow(int(_BASE), -1, 2**64), size)
        hashes[lo:hi] = (sums[ends[lo:hi] - base] - sums[at]) * inverse[at]
        lo = hi
    lengths = (ends - starts).astype(np.uint64)
    return mix64(hashes + lengths * _U(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, in text order, and the rows' offsets.

    A row with fewer than n words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(offsets)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    at = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], made)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = mix64(out * _BASE + padded[at + k])
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        x = np.array([counts[i]], np.uint64)
        for h in hashes[offsets[i] : offsets[i + 1]]:
            x = mix64(x * _BASE + h)
        out[out_offsets[i]] = x[0]
    return out, out_offsets


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the rows' offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else values[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def packed(a: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(b: bytes, kind: type, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def sequence_hashes(hashes: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Hashes of the n values from each of the places on; all of them must be there."""
    base, inverse = _powers(int(_BASE), len(hashes)), _powers(pow(int(_BASE), -1, 2**64), len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * base, out=sums[1:])
    return mix64((sums[at + n] - sums[at]) * inverse[at] + np.asarray(n).astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
