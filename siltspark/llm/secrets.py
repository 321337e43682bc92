"""Secret scans: fixed patterns, and Shannon entropy in sliding windows of candidate strings.

A candidate is a run of token characters.  Its character class (hex, alphanumeric or base64) sets
how high the entropy of some window of it must be; a window's entropy is kept by incremental counts
as it moves.  Candidates that match an allow-list (UUIDs, dates, example keys, paths and words) are
left out.  What a pattern has found is cut out of a candidate, and the rest, of LEAST characters or more
in a piece, is scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.llm.common import map_batches, slices, table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Window length, and the least entropy in bits of a window of each character class.
WINDOW = 20
LEAST_BITS = {"hex": 2.9, "alnum": 3.6, "base64": 3.8}
#: Strings of high entropy that are no secrets.
ALLOW = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9_=/+-]+"  # dates, numbers, rules
    r"|(?:[A-Za-z]+[-_/])*[A-Za-z]*"  # words and paths
    r"|.*EXAMPLE.*|.*(?:0123456789|abcdefghij|ABCDEFGHIJ).*"  # samples and alphabets
)
_LOG = [0.0] + [n * log2(n) for n in range(1, 4096)]


def char_class(s: str) -> str:
    return "hex" if not set(s) - set("0123456789abcdefABCDEF") else "alnum" if s.isalnum() else "base64"


def highest_entropy(s: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits a character, of any window of s (s itself if shorter)."""
    n = min(window, len(s))
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)
    best = 0.0
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        total += _LOG[k + 1] - _LOG[k]
        counts[c] = k + 1
        if i >= n:
            c = s[i - n]
            k = counts[c]
            total += _LOG[k - 1] - _LOG[k]
            counts[c] = k - 1
        if i >= n - 1:
            best = max(best, log2(n) - total / n)
    return best


def _left(lo: int, hi: int, base: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int]]:
    """What the spans of base, ascending and from number at on, leave of a stretch."""
    while at < len(base) and base[at][0] < hi:
        if base[at][0] > lo:
            yield lo, base[at][0]
        lo = max(lo, base[at][1])
        at += 1
    if lo < hi:
        yield lo, hi


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of every secret, by start and kind; code points, end exclusive."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted((lo, hi) for lo, _, hi in spans)
    at = 0
    for m in _CANDIDATE.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        for lo, hi in _left(m.start(), m.end(), base, at):
            s = text[lo:hi]
            if hi - lo >= LEAST and not s.isalpha() and not ALLOW.fullmatch(s) and highest_entropy(s) >= LEAST_BITS[char_class(s)]:
                spans.append((lo, 3, hi))
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each stretch of overlapping spans replaced by ``<secret>``."""
    out, at = [], 0
    for lo, _, hi in spans:
        if lo >= at:
            out += [text[at:lo], "<secret>"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """docs with ``secrets array<struct<start, kind, end>>``, and, if asked for, the text redacted.

    kind is a number into KINDS.  A null text has no secrets and stays null; a column named secrets
    is replaced.  Rows are independent, so repeated rows get equal results.
    """
    plain = docs.drop("secrets")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = batch.schema.get_field_index(text)
        for part in slices(batch, text, 1 << 23):
            texts = part.column(at).to_pylist()
            spans = [find_spans(t) if t else [] for t in texts]
            columns = list(part.columns)
            if redacted:
                columns[at] = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], part.column(at).type)
            found = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([*columns, found], [*part.schema.names, "secrets"])

    schema = plain.withColumn("secrets", F.expr("cast(null as array<struct<start: int, kind: int, end: int>>)")).schema
    return map_batches(plain, run, schema)


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of scan() over all documents."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.expr(f"cast(size(filter(secrets, x -> x.kind = {k})) as long)")
    base = _joined("filter(secrets, x -> x.kind < 3)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(_joined("secrets")).alias("spans"),
    )
