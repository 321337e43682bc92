"""Many patterns at once: one automaton over all literal patterns, in one Arrow pass over the texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns in one automaton, and regular expressions in one pass; more take another pass over the texts.
AUTOMATON_CHARS, REGEXES = 4_000_000, 256
#: Rows of which texts are Python strings at once.
ROWS = 128
HITS = "pattern_id long, start long, n long"


def _pass(df: DataFrame, keys: list[str], literals: list[tuple[int, str]], regexes: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for i, p in literals:
            same.setdefault(p, []).append(i)
        for p, ids in same.items():
            automaton.add_word(p, (len(p), ids))
        automaton.make_automaton()
        compiled = [(i, re.compile(p, re.I)) for i, p in regexes]
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            at, found = [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if text is None:
                    continue
                seen: dict[int, list[int]] = {}  # first place, where the last one ends, and how many
                for end, (size, ids) in automaton.iter(text) if same else ():
                    for i in ids:
                        hit = seen.setdefault(i, [end + 1 - size, 0, 0])
                        if end + 1 - size >= hit[1]:
                            hit[1:] = end + 1, hit[2] + 1
                for i, p in compiled:
                    spans = [m.start() for m in p.finditer(text)]
                    if spans:
                        seen[i] = [spans[0], 0, len(spans)]
                at += [row] * len(seen)
                found += [(i, s, n) for i, (s, _, n) in seen.items()]
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            hits = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, *hits], [*batch.schema.names[:-1], "pattern_id", "start", "n"])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    return df.select(*keys, "_text").mapInArrow(run, ", ".join([*own, HITS]))


def find_patterns(df: DataFrame, keys: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """keys, ``pattern_id, start, n``: a row for each pattern that a text holds, where first, and how often without overlaps.

    patterns: ``pattern_id long, pattern string`` and perhaps ``regex boolean`` (false without it).  Case doesn't count.
    Null and empty patterns, and null texts, find nothing.  Repeated rows give repeated hits; pattern ids are distinct.
    Literal patterns make one automaton, so a pass takes time by the texts' length and the hits, not by the number of
    patterns; the patterns, not the texts, go through the driver, in groups of AUTOMATON_CHARS.
    """
    regex = F.coalesce("regex", F.lit(False)) if "regex" in patterns.columns else F.lit(False)
    good = patterns.where("pattern <> ''").select("pattern_id", "pattern", regex.alias("regex"))
    size = good.agg(F.coalesce(F.sum(F.when(~F.col("regex"), F.char_length("pattern"))), F.lit(0)).alias("chars"), F.count_if("regex").alias("regexes")).first()
    groups = max(1, -(-size.chars // AUTOMATON_CHARS), -(-size.regexes // REGEXES))
    lowered = df.withColumn("_text", F.lower(F.col(text)))
    passes = []
    for g in range(groups):
        rows = good.where(F.pmod(F.xxhash64("pattern_id"), F.lit(groups)) == g).select("pattern_id", "regex", F.when(F.col("regex"), F.col("pattern")).otherwise(F.lower("pattern")).alias("p")).collect()
        passes.append(_pass(lowered, keys, [(r.pattern_id, r.p) for r in rows if not r.regex], [(r.pattern_id, r.p) for r in rows if r.regex]))
    return reduce(DataFrame.unionAll, passes)


#: What makes a command risky, and why.
RISKS = (
    ("rm -rf /", "destructive recursive deletion of root"),
    ("dd if=/dev/zero", "disk zeroing attempt"),
    ("curl | sh", "pipe curl output to shell"),
    ("wget -O - | sh", "pipe wget output to shell"),
    ("eval(", "dynamic code evaluation"),
    (">/dev/sda", "direct disk overwrite"),
    ("mkfs.", "filesystem format attempt"),
    ("nc -e", "netcat backdoor"),
    ("python -c 'import os", "Python code execution via CLI"),
    ("ssh -o StrictHostKeyChecking=no", "insecure SSH connection"),
    ("curl.*-F.*@", "potential file exfiltration via curl"),
    ("base64.*-d.*|", "base64 decoded pipe execution"),
)
#: What makes a command need approval.
DANGEROUS = (
    "rm -rf", "sudo ", "chmod 777", "chown",
    "dd if=", "mkfs.", "format",
    "curl | sh", "wget -O - | sh",
    ">/dev/sda", ">/dev/sdb",
    "git push --force", "git push -f",
    "docker rm -f", "docker system prune",
)
#: Folders for temporary files.
TEMPORARY = ("/tmp/", "\\Temp\\")


def scan_commands(docs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``doc_id, pattern, risk``: a row for each rule that a document's text breaks, whatever its case.

    rules: ``pattern, risk`` and perhaps ``regex boolean``; without them RISKS, DANGEROUS (as "needs approval") and two
    rules on the whole command: its first word lies in a folder for temporary files (in just this case), and it removes
    while it names a hidden file.  RISKS that look like regular expressions are literal texts.
    """
    spark = docs.sparkSession
    known = rules is None
    if rules is None:
        rules = spark.createDataFrame([*RISKS, *[(p, "needs approval") for p in DANGEROUS]], "pattern string, risk string")
    regex = F.coalesce("regex", F.lit(False)) if "regex" in rules.columns else F.lit(False)
    # equal rules are one; the id is of what makes a rule
    numbered = rules.select("pattern", "risk", regex.alias("regex")).distinct().withColumn("pattern_id", F.xxhash64("pattern", "regex", "risk"))
    hits = find_patterns(docs, ["doc_id"], "text", numbered).select("doc_id", "pattern_id")
    few = numbered.limit(10_001).count() <= 10_000
    found = hits.join(F.broadcast(numbered) if few else numbered, "pattern_id").select("doc_id", "pattern", "risk")
    if known:
        command = F.regexp_extract("text", r"^\s*(\S+)", 1)
        temporary = docs.where(reduce(lambda a, b: a | b, [command.contains(t) for t in TEMPORARY])).select("doc_id", F.lit(TEMPORARY[0]).alias("pattern"), F.lit("binary in temporary directory").alias("risk"))
        hidden = docs.where(F.col("text").contains("/.") & F.lower("text").contains("rm ")).select("doc_id", F.lit("/.").alias("pattern"), F.lit("deletion of hidden files").alias("risk"))
        found = found.unionAll(temporary).unionAll(hidden)
    return found
