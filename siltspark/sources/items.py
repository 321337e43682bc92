"""A sink of one file an item: sessions as JSON or markdown, concepts as files that are read back whole.

Rows are pieces of files; the pieces of one file come one after the other, so a file is written as they come and no list
of them is made.  A task writes each file beside its place and then moves it there, so that a task that runs again puts the
same file in the same place; the folder has a ``_SUCCESS`` file when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from siltspark.sources.tables import export_sessions


class _Files(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _place(self) -> tuple[fs.FileSystem, str]:
        """The file system is opened where it is used, as it can't travel."""
        return fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("/") else f"file://{self.root.removeprefix('file:')}")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = self._place()
        made: set[str] = set()
        at, out, held = None, None, ""
        for row in rows:
            if row.path != at:
                if out is not None:
                    out.close()
                    system.move(held, f"{root}/{at}")
                at = row.path
                if at.startswith("/") or ".." in at.split("/"):
                    raise ValueError(f"{at} is no place below the folder")
                folder = f"{root}/{at}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                held = f"{root}/{at}._{uuid.uuid4().hex}"
                out = system.open_output_stream(held)
            out.write((row.piece or "").encode())
        if out is not None:
            out.close()
            system.move(held, f"{root}/{at}")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._place()
        system.create_dir(root, recursive=True)
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was written stays, without a _SUCCESS file; another run overwrites it."""


class ItemFiles(DataSource):
    """``path string, piece string``: consecutive pieces of a path are one text file below the option path."""

    @classmethod
    def name(cls) -> str:
        return "item_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Files(self.options["path"])


def write_items(pieces: DataFrame, folder: str) -> None:
    """pieces: ``path, position, piece``; a file's pieces in the order of position (then text), each file by one task."""
    pieces.sparkSession.dataSource.register(ItemFiles)
    ordered = pieces.repartition("path").sortWithinPartitions("path", "position", "piece")
    ordered.select("path", "piece").write.format("item_files").mode("append").save(folder)


#: How a turn begins in a markdown export, by role, and how it ends.
HEADINGS = {"user": "### 👤 User\n\n", "assistant": "### 🤖 Assistant\n\n", "tool": "#### 🔧 Tool Result\n\n```\n"}


def session_pieces(messages: DataFrame, kind: str, now: str) -> DataFrame:
    """``path, position, piece`` of every session's export, json or markdown; system and blank turns are left out.

    now: what stands there as the time of the export.  A file's name is its session's id, escaped as in URLs.
    """
    if kind not in ("json", "markdown"):
        raise ValueError(f"no export as {kind}")
    turns = export_sessions(messages).withColumn("session_id", F.col("session_id").cast("string"))
    named = F.col("session_id")
    if kind == "json":
        event = F.to_json(F.struct(F.col("turn_index").alias("index"), "role", "content"))
        body = F.concat(F.when(F.col("turn_index") > 0, ",").otherwise(""), F.lit("\n    "), event)
        first = F.concat(F.lit('{\n  "session_id": '), _quoted(named), F.lit(',\n  "exported_at": '), _quoted(F.lit(now)), F.lit(',\n  "events": ['))
        last = F.concat(F.lit('\n  ],\n  "event_count": '), F.col("n").cast("string"), F.lit("\n}\n"))
    else:
        heading = F.concat(F.lit("### "), "role", F.lit("\n\n"))
        for role, text in HEADINGS.items():
            heading = F.when(F.col("role") == role, text).otherwise(heading)
        body = F.concat(heading, "content", F.when(F.col("role") == "tool", "\n```\n\n").otherwise("\n\n"))
        first = F.concat(F.lit("# Session: "), F.left(named, F.lit(8)), F.lit(f"\n\n**Exported**: {now}\n\n---\n\n"))
        last = F.concat(F.lit("\n---\n*"), F.col("n").cast("string"), F.lit(" message turns exported*\n"))
    ends = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    ends = ends.select("session_id", F.inline(F.array(F.struct(F.lit(-1).cast("long").alias("position"), first.alias("piece")), F.struct(F.col("n").alias("position"), last.alias("piece")))))
    every = turns.select("session_id", F.col("turn_index").cast("long").alias("position"), body.alias("piece")).unionByName(ends)
    ending = ".json" if kind == "json" else ".md"
    return every.select(F.concat(F.url_encode("session_id"), F.lit(ending)).alias("path"), "position", "piece")


def write_sessions(messages: DataFrame, folder: str, kind: str = "json", now: str = "2024-02-01 00:00:00") -> None:
    """A file for each session, as session_pieces makes it."""
    write_items(session_pieces(messages, kind, now), folder)


#: Fields of a concept's front matter that have columns of their own.
FIELDS = ("type", "title", "description", "resource", "tags", "timestamp")


def _quoted(text: Column) -> Column:
    """The text as a JSON string, which front matter may hold too."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def concept_pieces(concepts: DataFrame, version: str = "0.1", now: str = "2024-02-01") -> DataFrame:
    """``path, position, piece``: a file for each concept, and index.md and log.md of the bundle.

    concepts: ``id, type, title, description, resource, tags array, timestamp, extra map<string, string>, body``.  Empty
    fields are left out.  The index lists the concepts by type, then by title and id.
    """
    line = lambda k: F.when(F.coalesce(F.col(k), F.lit("")) != "", F.concat(F.lit(f"{k}: "), _quoted(F.col(k)), F.lit("\n"))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), _quoted(t), F.lit("\n"))), ""))).otherwise("")
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit(": "), _quoted(e["value"]), F.lit("\n"))), "")
    front = F.concat(F.lit("---\n"), line("type"), line("title"), line("description"), line("resource"), F.coalesce(tags, F.lit("")), line("timestamp"), F.coalesce(extra, F.lit("")), F.lit("---\n"))
    files = concepts.select(F.concat("id", F.lit(".md")).alias("path"), F.lit("").alias("position"), F.concat(front, F.coalesce("body", F.lit(""))).alias("piece"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id"))
    at = lambda *c: F.concat_ws("\u0001", *c)
    listed = concepts.select(F.lit("index.md").alias("path"), at("type", F.lit("1"), title, F.col("id")).alias("position"), F.concat(F.lit("- ["), title, F.lit("]("), "id", F.lit(".md)\n")).alias("piece"))
    types = concepts.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("index.md").alias("path"), at("type", F.lit("0")).alias("position"), F.concat(F.lit("\n## "), "type", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n")).alias("piece"))
    total = concepts.agg(F.count("*").alias("n"))
    heads = total.select(F.inline(F.array(
        F.struct(F.lit("index.md").alias("path"), F.lit("").alias("position"), F.concat(F.lit(f"---\ntype: index\nokf_version: \"{version}\"\nconcepts: "), F.col("n").cast("string"), F.lit("\n---\n\n# Index\n")).alias("piece")),
        F.struct(F.lit("log.md").alias("path"), F.lit("").alias("position"), F.concat(F.lit(f"# Log\n\n## {now}\n\n- Added: index.md ("), F.col("n").cast("string"), F.lit(" concepts)\n")).alias("piece")),
    )))
    return files.unionByName(listed).unionByName(types).unionByName(heads)


def write_concepts(concepts: DataFrame, folder: str, version: str = "0.1", now: str = "2024-02-01") -> None:
    """A bundle of concept files with index and log, as concept_pieces makes it."""
    write_items(concept_pieces(concepts, version, now), folder)


def read_concepts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(concepts, rejects)`` of a folder of concept files, with all that their front matter has.

    A concept's id is its path below the folder.  Values may be JSON strings or plain, tags a list in brackets or one of
    dashes, and a key that has no column is in extra (the first of several).  Index and log are left out; a file whose front
    matter isn't closed is a reject.
    """
    root = folder.split("://")[-1].rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    raw = files.select("path", F.decode("content", "UTF-8").alias("raw")).where(~F.col("path").rlike(r"/(index|log)\.md$"))
    closed = F.col("raw").rlike(r"(?s)\A---\n(?:.*?\n)?---(?:\n|\z)")
    raw = raw.withColumns({"front": F.regexp_extract("raw", r"(?s)\A---\n(.*?)---(?:\n|\z)", 1), "ok": ~F.col("raw").startswith("---\n") | closed})
    plain = lambda v: F.when(v.rlike(r'^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    entry = r"(?m)^([A-Za-z0-9_.-]+):[ \t]*(.*?)[ \t]*$"
    keys, values = (F.regexp_extract_all("front", F.lit(entry), F.lit(k)) for k in (1, 2))
    raw = raw.withColumns({"keys": keys, "values": values})
    field = lambda k: F.coalesce(plain(F.try_element_at("values", F.nullif(F.array_position("keys", F.lit(k)), F.lit(0)).cast("int"))), F.lit(""))
    inline = F.split(F.regexp_extract("front", r"(?m)^tags:[ \t]*\[([^\]]*)\]", 1), r"\s*,\s*")
    block = F.regexp_extract_all(F.regexp_extract("front", r"(?m)^tags:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1), F.lit(r"(?m)^[ \t]*- (.*?)[ \t]*$"), F.lit(1))
    tags = F.filter(F.transform(F.concat(inline, block), lambda t: plain(F.trim(t))), lambda t: t != "")
    pairs = F.transform("keys", lambda k, i: F.struct(k.alias("key"), plain(F.get("values", i)).alias("value"), (F.array_position("keys", k) == i + 1).alias("first")))
    extra = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["first"] & ~p["key"].isin(*FIELDS)), lambda p: F.struct(p["key"], p["value"])))
    concepts = raw.where("ok").select(
        F.regexp_replace(F.substring_index("path", root, -1), r"\.md$", "").alias("id"), F.coalesce(F.nullif(field("type"), F.lit("")), F.lit("concept")).alias("type"),
        *[field(k).alias(k) for k in ("title", "description", "resource")], tags.alias("tags"), field("timestamp").alias("timestamp"), extra.alias("extra"),
        F.regexp_replace("raw", r"(?s)\A---\n(?:.*?\n)?---(?:\n|\z)", "").alias("body"),
    )
    return concepts, raw.where("not ok").select("path", F.lit("front matter is not closed").alias("reason"))
