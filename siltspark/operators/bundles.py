"""Concept bundles: links, indexes, catalog entries, and concepts that describe tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve_concept_links(concepts: DataFrame) -> DataFrame:
    """source, link, target, found: each distinct .md link of a concept's body, made relative to its folder.

    concepts: ``id, body``, an id being a path without its ending.  One shuffle on ids, none of bodies.
    """
    links = F.array_distinct(F.filter(F.regexp_extract_all("body", F.lit(r"\[[^\]]*\]\(([^)]*)\)"), F.lit(1)), lambda x: x.endswith(".md")))
    rows = concepts.select(F.col("id").alias("source"), F.explode(links).alias("link"))
    parts = F.filter(F.split(F.concat(F.regexp_replace("source", r"[^/]*$", ""), F.lit("/"), "link"), "/"), lambda x: ~x.isin("", "."))
    rises = lambda a: (F.size(a) == 0) | F.coalesce(F.try_element_at(a, F.lit(-1)) == "..", F.lit(False))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & ~rises(a), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    rows = rows.withColumn("target", F.regexp_replace(F.array_join(folded, "/"), r"\.md$", ""))
    known = concepts.select(F.col("id").alias("target"), F.lit(True).alias("found")).distinct()
    return rows.join(known, "target", "left").select("source", "link", "target", F.coalesce("found", F.lit(False)).alias("found"))


def concept_types(concepts: DataFrame) -> DataFrame:
    """type, n, first, last of the sorted ids; counts travel, ids don't."""
    return concepts.groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def concept_index(concepts: DataFrame) -> DataFrame:
    """type, id sorted over range partitions, so that a type of any size is listed by many tasks."""
    return concepts.select("type", "id").orderBy("type", "id")


def overview(concepts: DataFrame, most: int = 500) -> DataFrame:
    """One text that lists the types with their counts, cut at so many characters."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(F.lit("- "), x["type"], F.lit(": "), x["n"].cast("string"))), "\n")
    text = concept_types(concepts).agg(lines.alias("t"))
    return text.select(F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("\n... (truncated)"))).otherwise(F.col("t")).alias("overview"))


def bundle_entry(concepts: DataFrame, name: str, publisher: str = "example.com", version: str = "0.1", media_type: str = "application/knowledge-bundle+json") -> DataFrame:
    """A catalog row for a bundle: identifier, type, version, number of concepts and their sorted types."""
    total = concept_types(concepts).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("concept_count"), F.sort_array(F.collect_set("type")).alias("concept_types"))
    return total.select(F.lit(f"urn:air:{publisher}:knowledge:{name}").alias("identifier"), F.lit(name).alias("display_name"), F.lit(media_type).alias("type"), F.lit(version).alias("version"), "concept_count", "concept_types")


def describe_tables(spark: SparkSession, tables: dict[str, DataFrame], links: dict[tuple[str, str], str]) -> DataFrame:
    """A concept for each table from its schema; links names the table that a (table, column) refers to."""
    rows = []
    for name, df in sorted(tables.items()):
        columns = "\n".join(f"- {f.name}: {f.dataType.simpleString()}" for f in df.schema)
        refers = "\n".join(f"- {c} -> [{to}]({to}.md)" for (t, c), to in sorted(links.items()) if t == name)
        rows.append((f"tables/{name}", "table", name, f"# Columns\n{columns}" + (f"\n\n# Links\n{refers}" if refers else "")))
    return spark.createDataFrame(rows, "id string, type string, title string, body string")


def import_report(outputs: dict[str, DataFrame]) -> DataFrame:
    """output, n: how many rows each output of an import has, such as rows, triples, chunks and errors."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n") for name, df in outputs.items()])
