"""Resource catalogs: filters, facets, scoring, federation, upserts, trust and compliance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What an identity type adds to a trust score.
IDENTITY_WEIGHTS = {"spiffe": 0.3, "did": 0.25, "x509": 0.2, "dns": 0.15}
_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
URN_PATTERN = rf"^urn:air:{_LABEL}(\.{_LABEL})+:.+$"


def publisher(identifier: Column) -> Column:
    """The publisher of a URN; null where it is none."""
    return F.when(identifier.rlike(r"^urn:[^:]+:[^:]+:."), F.try_element_at(F.split(identifier, ":"), F.lit(3)))


def urn_parts(identifier: Column) -> Column:
    """publisher, namespace and name of urn:air:publisher[:namespace]:name; a name may hold colons."""
    p = F.split(identifier, ":")
    long = F.size(p) > 4
    name = F.when(long, F.array_join(F.slice(p, F.lit(5), F.greatest(F.size(p) - 4, F.lit(0))), ":")).otherwise(F.try_element_at(p, F.lit(4)))
    return F.struct(F.try_element_at(p, F.lit(3)).alias("publisher"), F.when(long, p[3]).alias("namespace"), name.alias("name"))


def catalog_filter(entries: DataFrame, type: str | None = None, tags: list[str] | None = None, capabilities: list[str] | None = None, query: str | None = None) -> DataFrame:
    """Exact type, any tag, any capability, query as a substring of name or description."""
    if type:
        entries = entries.where(F.col("type") == type)
    for column, wanted in (("tags", tags), ("capabilities", capabilities)):
        if wanted:
            entries = entries.where(F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
    if query:
        entries = entries.where(F.lower("display_name").contains(query.lower()) | F.lower("description").contains(query.lower()))
    return entries


def explore_filter(entries: DataFrame, all_tags: list[str] | None = None, publisher_is: str | None = None, query: str | None = None) -> DataFrame:
    """All tags, whatever their case; publisher; query also in tags and capabilities."""
    if all_tags:
        wanted = F.array(*[F.lit(t.lower()) for t in all_tags])
        entries = entries.where(F.size(F.array_except(wanted, F.transform("tags", F.lower))) == 0)
    if publisher_is:
        entries = entries.where(publisher(F.col("identifier")) == publisher_is)
    if query:
        q = query.lower()
        inside = lambda c: F.exists(c, lambda x: F.lower(x).contains(q))
        entries = entries.where(F.lower("display_name").contains(q) | F.lower("description").contains(q) | inside("tags") | inside("capabilities"))
    return entries


def validate_entries(entries: DataFrame) -> DataFrame:
    """entries with ``reasons``: empty where valid."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [
        (blank("identifier"), "identifier"), (blank("display_name"), "display_name"), (blank("type"), "type"),
        (F.col("url").isNull() == F.col("data").isNull(), "url or data"), (~F.coalesce(F.col("identifier").rlike(URN_PATTERN), F.lit(False)), "urn"),
    ]
    return entries.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, reason) for bad, reason in checks])))


def facets(entries: DataFrame) -> DataFrame:
    """facet, value, n for types, tags, capabilities and publishers."""
    pairs = F.concat(
        F.array(F.struct(F.lit("type").alias("facet"), F.col("type").alias("value"))), F.transform("tags", lambda x: F.struct(F.lit("tag").alias("facet"), x.alias("value"))),
        F.transform("capabilities", lambda x: F.struct(F.lit("capability").alias("facet"), x.alias("value"))),
        F.array(F.struct(F.lit("publisher").alias("facet"), publisher(F.col("identifier")).alias("value"))),
    )
    return entries.select(F.inline(pairs)).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def browse(entries: DataFrame, by: str) -> DataFrame:
    """Groups with the display names of their members, sorted."""
    return entries.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("display_name")), "|").alias("members"))


def distinct_values(entries: DataFrame, column: str) -> DataFrame:
    """The values of a column, of the lists in it, or of the publishers, once each and in order; null is none."""
    if column == "publisher" and column not in entries.columns:
        value = publisher(F.col("identifier"))
    else:
        value = F.explode(column) if entries.schema[column].dataType.typeName() == "array" else F.col(column)
    return entries.select(value.alias("value")).where("value is not null").distinct().orderBy("value")


def catalog_score(query: str) -> Column:
    """0.4 name, 0.3 description, 0.2 any tag, 0.1 any capability; 1 for an empty query."""
    q = query.lower()
    if not q:
        return F.lit(1.0)
    inside = lambda c: F.exists(c, lambda x: F.lower(x).contains(q))
    parts = [(F.lower("display_name").contains(q), 0.4), (F.lower("description").contains(q), 0.3), (inside("tags"), 0.2), (inside("capabilities"), 0.1)]
    return reduce(lambda a, b: a + b, [F.when(hit, w).otherwise(0.0) for hit, w in parts])


def catalog_search(entries: DataFrame, query: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """Scored, sorted, then paged; limit is 100 at most."""
    hits = entries.select("identifier", F.round(catalog_score(query), 4).alias("score")).where("score > 0")
    return page(hits, [F.desc("score"), F.col("identifier")], offset, limit)


def page(df: DataFrame, order: list[Column], offset: int, limit: int = 20) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, 100))


def top_per_registry(results: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("registry").orderBy(F.desc("score"), "identifier")
    return results.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def federated_search(results: DataFrame, k: int) -> DataFrame:
    """At most k results of each registry, each identifier once with its highest score."""
    best = top_per_registry(results, k).groupBy("identifier").agg(F.max("score").alias("score"), F.max_by("registry", F.struct("score", -F.col("registry"))).alias("registry"))
    return best


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The highest version of each key over both."""
    both = base.unionByName(updates)
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def register(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """updates with ``accepted``: whether their key is new to base and no earlier update has it; a null key never is."""
    known = base.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(W.partitionBy(key).orderBy(order)) == 1
    marked = updates.withColumn("_first", first).join(known, F.col(key) == F.col("_k"), "left")
    return marked.withColumn("accepted", F.col("_first") & F.col("_known").isNull() & F.col(key).isNotNull()).drop("_first", "_k", "_known")


def remove(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def trust_score(manifests: DataFrame) -> DataFrame:
    """0.2, the identity type's weight, 0.1 per attestation and 0.2 if trusted; 1 at most."""
    weight = reduce(lambda a, kv: a.when(F.col("identity_type") == kv[0], kv[1]), list(IDENTITY_WEIGHTS.items())[1:], F.when(F.col("identity_type") == "spiffe", 0.3)).otherwise(0.1)
    score = 0.2 + weight + 0.1 * F.size("attestations") + F.when(F.col("trusted"), 0.2).otherwise(0.0)
    return manifests.withColumn("score", F.round(F.least(F.lit(1.0), score), 4))


def missing_required(manifests: DataFrame, required: list[str]) -> DataFrame:
    """A row for each required attestation that a manifest lacks."""
    return manifests.select("manifest_id", F.explode(F.array_except(F.array(*map(F.lit, required)), "attestations")).alias("missing"))


def identity_type(identity: Column) -> Column:
    """did, spiffe, dns, x509 or pgp by an identity's prefix; null for any other."""
    out = F.when(identity.startswith("did:"), "did").when(identity.startswith("spiffe://"), "spiffe")
    for kind in ("dns", "x509", "pgp"):
        out = out.when(identity.startswith(kind + ":"), kind)
    return out


#: How severe a violation is.
SEVERITIES = {"LOW_TRUST_SCORE": "high", "INVALID_IDENTITY_TYPE": "critical", "MISSING_CERTIFICATION": "high", "EXPIRED_MANIFEST": "critical"}


def _violations(least: float, identities: list[str], required: list[str], now: str | None) -> Column:
    expired = F.col("expires_at") < F.lit(now).cast("timestamp") if now else F.lit(False)
    return F.array_compact(F.array(
        F.when(F.col("score") < least, "LOW_TRUST_SCORE"), F.when(~F.col("identity_type").isin(*identities), "INVALID_IDENTITY_TYPE"),
        F.when(F.size(F.array_except(F.array(*map(F.lit, required)), "attestations")) > 0, "MISSING_CERTIFICATION"),
        F.when(expired, "EXPIRED_MANIFEST"),
    ))


def violations(manifests: DataFrame, least: float, identities: list[str], required: list[str], now: str | None = None) -> DataFrame:
    """``manifest_id, violation, severity``: a row for each violation of a policy."""
    each = trust_score(manifests).select("manifest_id", F.explode(_violations(least, identities, required, now)).alias("violation"))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return each.withColumn("severity", severity[F.col("violation")])


def compliance(manifests: DataFrame, least: float, identities: list[str], required: list[str], now: str | None = None) -> DataFrame:
    """Violations of a policy and whether a manifest complies; the score is 1 or 0.  With now, ``expires_at`` counts too."""
    m = trust_score(manifests)
    found = _violations(least, identities, required, now)
    return m.select("manifest_id", F.array_join(found, ",").alias("violations"), (F.size(found) == 0).alias("compliant"), F.when(F.size(found) == 0, 1.0).otherwise(0.0).alias("compliance_score"))


def attach_trust(results: DataFrame, registries: DataFrame) -> DataFrame:
    """results with the name and trust of their registry; unknown where it isn't listed."""
    known = registries.select("registry", "registry_name", "trust").dropDuplicates(["registry"])
    return results.join(known, "registry", "left").fillna("unknown", ["registry_name", "trust"])


def embed_text(entries: DataFrame) -> DataFrame:
    """``identifier, part, text``: an entry's main text, and each of its representative queries by itself."""
    main = F.concat_ws(" ", "display_name", "description", F.array_join("tags", " "), F.array_join("capabilities", " "))
    texts = F.concat(F.array(main), F.coalesce(F.col("queries"), F.array().cast("array<string>")))
    return entries.select("identifier", F.posexplode(texts).alias("part", "text"))


def valid_attestations(manifests: DataFrame, now: str) -> DataFrame:
    """manifest_id, n_valid, expired, valid: attestations with a URI whose period holds now, and whether all do in a manifest that isn't expired.

    attestations: structs of type, uri, valid_from and valid_until; a null bound, list or expiry is open or empty.
    """
    moment = F.lit(now).cast("timestamp")
    good = lambda a: (F.coalesce(a["uri"], F.lit("")) != "") & F.coalesce(a["valid_from"] <= moment, F.lit(True)) & F.coalesce(a["valid_until"] >= moment, F.lit(True))
    m = manifests.withColumn("_n", F.coalesce(F.size(F.filter("attestations", good)), F.lit(0)))
    expired = F.coalesce(F.col("expires_at") < moment, F.lit(False))
    total = F.when(F.col("attestations").isNull(), 0).otherwise(F.size("attestations"))
    n = F.greatest(F.col("_n"), F.lit(0))
    return m.select("manifest_id", n.alias("n_valid"), expired.alias("expired"), ((n == total) & ~expired).alias("valid"))
