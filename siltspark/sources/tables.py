"""Sources: driver tables and the frames derived from them, documents, bundles, catalogs, change logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltspark.sources.ranged import read_ranged, write_segment

#: File types that a document directory scan takes.
DOCUMENT_TYPES = ("md", "txt", "json", "yaml", "yml", "csv", "html", "xml", "log")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: session_id, user_id, turn, role, content."""
    c = load(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 10).alias("user_id"), "turn", "role", F.col("text").alias("content"))


def read_catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries made of part: identifier, display_name, type, url, description, tags, capabilities, version."""
    brand = F.lower(F.regexp_replace("p_brand", "#", "-"))
    key = F.col("p_partkey").cast("string")
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("urn:air:"), brand, F.lit(".example.com:part:"), key).alias("identifier"), F.col("p_name").alias("display_name"),
        F.concat(F.lit("application/"), F.lower("p_type"), F.lit("+json")).alias("type"), F.concat(F.lit("https://example.com/p/"), key).alias("url"),
        F.concat("p_name", F.lit(" size "), F.col("p_size").cast("string")).alias("description"), F.split("p_name", " ").alias("tags"),
        F.array("p_brand").alias("capabilities"), F.col("p_partkey").alias("version"),
    )


CATALOG_SQL = """catalog AS (SELECT concat('urn:air:', lower(replace(p_brand,'#','-')), '.example.com:part:', cast(p_partkey AS VARCHAR)) AS identifier,
 p_name AS display_name, concat('application/', lower(p_type), '+json') AS type, concat('https://example.com/p/', cast(p_partkey AS VARCHAR)) AS url,
 concat(p_name, ' size ', cast(p_size AS VARCHAR)) AS description, string_split(p_name, ' ') AS tags, [p_brand] AS capabilities, p_partkey AS version FROM part)"""


def read_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and traces made of events: name, user_id, ts, duration_ms, success, error_count, quality, event_id."""
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("error_count"),
        (F.col("value") / 1000).alias("quality"), "event_id",
    )


TRACES_SQL = """traces AS (SELECT event_type AS name, user_id, ts, value AS duration_ms, event_type <> 'error' AS success,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count, value / 1000 AS quality, event_id FROM events)"""


def read_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = load(spark, sf_dir, "events"), load(spark, sf_dir, "documents")
    every = F.broadcast(d.agg(F.count("*").alias("n_docs")))  # one row
    return e.crossJoin(every).join(d, F.col("doc_id") == F.col("event_id") % F.col("n_docs")).select(
        F.col("event_id").alias("memory_id"), "user_id", F.col("text").alias("memory"), F.col("ts").cast("timestamp").alias("updated_at")
    )


MEMORIES_SQL = "memories AS (SELECT e.event_id AS memory_id, e.user_id, d.text AS memory, e.ts AS updated_at FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"


def read_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("spiffe", "did", "x509", "dns", "pgp")])
    return load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("manifest_id"), F.col("s_name").alias("identity"), F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("identity_type"),
        F.slice(F.array(F.lit("SOC2-Type1"), F.lit("SOC2-Type2"), F.lit("ISO27001")), F.lit(1), (F.col("s_suppkey") % 4).cast("int")).alias("attestations"),
        (F.col("s_acctbal") > 5000).alias("trusted"),
    )


MANIFESTS_SQL = """manifests AS (SELECT s_suppkey AS manifest_id, s_name AS identity, ['spiffe','did','x509','dns','pgp'][s_suppkey % 5 + 1] AS identity_type,
 ['SOC2-Type1','SOC2-Type2','ISO27001'][1 : s_suppkey % 4] AS attestations, s_acctbal > 5000 AS trusted FROM supplier)"""


def read_docs(spark: SparkSession, path: str, types: tuple[str, ...] = DOCUMENT_TYPES) -> DataFrame:
    """A directory of text files, recursively: path, title (file stem), tags (the type), text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(types) + "}").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        "path", F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.array(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("tags"), F.decode("content", "UTF-8").alias("text")
    )


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concept files with front matter: (concepts, rejects); index and log files are left out.

    A concept's id is its path below the bundle's, without the ending.
    """
    root = path.split("://")[-1].rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    raw = files.select("path", F.decode("content", "UTF-8").alias("raw")).where(~F.col("path").rlike(r"/(index|log)\.md$"))
    block = F.regexp_extract("raw", r"(?s)\A---\n(.*?)\n---\n?", 1)
    opened = F.col("raw").startswith("---\n")
    closed = F.col("raw").rlike(r"(?s)\A---\n.*?\n---")
    raw = raw.withColumns({"front": block, "ok": ~opened | closed})
    field = lambda k: F.regexp_extract("front", rf"(?m)^{k}:\s*\"?([^\"\n]*?)\"?\s*$", 1)
    concepts = raw.where("ok").select(
        F.regexp_replace(F.substring_index("path", root, -1), r"\.md$", "").alias("id"), "path",
        F.coalesce(F.nullif(field("type"), F.lit("")), F.lit("concept")).alias("type"), field("title").alias("title"), field("description").alias("description"),
        F.expr(r"filter(transform(split(regexp_extract(front, '(?m)^tags:\\s*\\[([^\\]]*)\\]', 1), ','), x -> trim(x)), x -> x <> '')").alias("tags"),
        F.regexp_replace("raw", r"(?s)\A---\n.*?\n---\n?", "").alias("body"),
    )
    return concepts, raw.where("not ok").select("path", F.lit("front matter is not closed").alias("reason"))


def write_bundle(concepts: DataFrame, path: str) -> None:
    """Concepts as text, partitioned by type, and an index of ids by type."""
    text = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), "type"), F.concat(F.lit("title: "), "title"), F.lit("---"), "body")
    concepts.select("type", text.alias("value")).write.partitionBy("type").mode("overwrite").text(f"{path}/concepts")
    concepts.groupBy("type").agg(F.sort_array(F.collect_list("id")).alias("ids")).write.mode("overwrite").json(f"{path}/index")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog document (host, specVersion, entries) as its entries."""
    return spark.read.json(path, multiLine=True).select("specVersion", F.explode("entries").alias("e")).select("specVersion", "e.*")


def write_catalog(entries: DataFrame, path: str, host: str = "", spec_version: str = "1.0") -> None:
    """Entry rows by publisher, each with its host and version, not one document; read_catalog_rows reads them."""
    known = F.when(F.col("identifier").rlike(r"^urn:[^:]+:[^:]+:."), F.try_element_at(F.split("identifier", ":"), F.lit(3)))
    entries.withColumns({"publisher": known, "host": F.lit(host), "specVersion": F.lit(spec_version)}).write.partitionBy("publisher").mode("overwrite").json(path)


def read_catalog_rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What write_catalog has written, with publisher, host and specVersion; schema: of the entries."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*[f for f in fields if f.name not in ("host", "specVersion")]]).add("host", "string").add("specVersion", "string").add("publisher", "string")
    return spark.read.schema(whole).json(path)


def read_csv_mapped(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(triples, errors) of a CSV file with a header: one triple per column of a good row.

    A row is bad if a value doesn't fit the schema or it has another number of values; errors has its key and its text.
    Values are read as text and held against the schema here, for a scan only sees what is wrong in columns that it reads.
    """
    fields = StructType.fromDDL(schema).fields
    texts = ", ".join(f"`{f.name}` string" for f in fields) + ", _bad string"
    rows = spark.read.option("columnPruning", "false").csv(path, schema=texts, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    misfit = reduce(Column.__or__, [F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull() for f in fields], F.col("_bad").isNotNull())
    pairs = F.array(*[F.struct(F.lit(f.name).alias("p"), F.col(f.name).cast(f.dataType).cast("string").alias("o")) for f in fields if f.name != key])
    text = F.coalesce("_bad", F.array_join(F.array(*[F.coalesce(f.name, F.lit("")) for f in fields]), ","))
    return rows.where(~misfit).select(F.col(key).alias("s"), F.inline(pairs)), rows.where(misfit).select(key, text.alias("_bad"))


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """``## date`` headings and ``- Action: path (reason)`` bullets as rows."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "t"))
    date = F.nullif(F.regexp_extract("t", r"^##\s+(\S+)", 1), F.lit(""))
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    item = r"^- (\w+): (\S+)(?: \((.*)\))?$"
    rows = text.withColumn("date", F.last(date, ignorenulls=True).over(w)).where(F.col("t").rlike(item))
    return rows.select("date", *[F.regexp_extract("t", item, k).alias(n) for k, n in ((1, "action"), (2, "path"), (3, "reason"))])


def export_sessions(messages: DataFrame) -> DataFrame:
    """Turns worth exporting, numbered from 0 in each session; system and blank turns are dropped."""
    good = messages.where("role <> 'system' and trim(content) <> ''")
    return good.select("session_id", (F.row_number().over(W.partitionBy("session_id").orderBy("turn")) - 1).alias("turn_index"), "role", "content")


def write_archive(articles: DataFrame, path: str, partitions: int | None = None) -> None:
    """Articles sorted by (ns, url) over ranges of files, with a manifest of the ranges; by default as many as shuffle partitions."""
    write_segment(articles, path, ("ns", "url"), 0, partitions)


def archive_get(spark: SparkSession, path: str, ns: str, url: str) -> DataFrame:
    """The article of a key; only files whose range holds the key are opened."""
    return archive_look_up(spark, path, spark.createDataFrame([(ns, url)], "ns string, url string"))


def archive_look_up(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The articles of a table of keys ``ns, url``, each once; only files whose range holds one of them are opened.

    Keys that no article has give no row; null keys neither.
    """
    wanted = keys.select("ns", "url").where("ns is not null and url is not null").distinct()
    asked = wanted.select(F.struct("ns", "url").alias("_key"))
    found = read_ranged(spark, path, asked, lambda lo, hi: (lo <= F.col("_key")) & (F.col("_key") <= hi))
    return found.drop("segment", "part").join(wanted, ["ns", "url"], "left_semi")


#: What a crawl's manifest has of a page beside its url, and what of it a page may lack.
SNAPSHOT = "url string, content_hash string, size int, status int, content_type string, etag string, last_modified string, fetched_at timestamp, crawl_id string"


def write_snapshot(pages: DataFrame, path: str, crawl_id: str) -> None:
    """A crawl's manifest: url, content hash and size, and what pages have of status, content type, etag, time.

    Only this crawl's folder is written, so a crawl that is written again replaces itself and no other.
    """
    given = [F.col(f.name).cast(f.dataType) if f.name in pages.columns else F.lit(None).cast(f.dataType) for f in StructType.fromDDL(SNAPSHOT)[3:8]]
    names = [f.name for f in StructType.fromDDL(SNAPSHOT)[3:8]]
    out = pages.select("url", F.concat(F.lit("md5:"), F.md5("html")).alias("content_hash"), F.octet_length("html").alias("size"), *[c.alias(n) for c, n in zip(given, names)], F.lit(crawl_id).alias("crawl_id"))
    out.write.partitionBy("crawl_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_snapshot(spark: SparkSession, path: str, crawl_id: str) -> DataFrame:
    """The manifest of one crawl, whose folder alone is read."""
    return spark.read.schema(SNAPSHOT).parquet(path).where(F.col("crawl_id") == crawl_id)


def diff_crawls(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """``url, status, reason``: new, unchanged, changed or removed between any two crawls, and what told it.

    A page is unchanged by a 304 answer, an equal etag, an equal last-modified time or an equal content hash, in this order;
    an empty header tells nothing.  Urls are distinct in a crawl.
    """
    o, n = (read_snapshot(spark, path, c).select("url", F.struct("status", F.nullif("etag", F.lit("")).alias("etag"), F.nullif("last_modified", F.lit("")).alias("last_modified"), "content_hash").alias(k)) for c, k in ((old, "o"), (new, "n")))
    both = o.join(n, "url", "full")
    same = F.coalesce(*[F.when(F.col(f"o.{c}") == F.col(f"n.{c}"), name) for c, name in (("etag", "etag"), ("last_modified", "last-modified"), ("content_hash", "hash"))])
    told = F.when(F.col("o").isNull(), "not cached").when(F.col("n").isNull(), "gone").when(F.col("n.status") == 304, "not modified").otherwise(F.coalesce(same, F.lit("differs")))
    status = F.when(told == "not cached", "new").when(told == "gone", "removed").when(told == "differs", "changed").otherwise("unchanged")
    return both.select("url", status.alias("status"), told.alias("reason"))


def read_eval(spark: SparkSession, path: str, schema: str = "case_id string, response string, expected_pattern string, min_length int, tools array<string>, expected_tools array<string>") -> DataFrame:
    """Evaluation cases from JSON files, each one array of cases or one case a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_eval(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
