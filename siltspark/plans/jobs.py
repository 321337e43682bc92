"""Whole jobs made of the operators; each returns named frames that a caller writes or joins further."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltspark.functions.plugins import Embedder, embed, hashed_terms
from siltspark.operators import assets, catalog, containment, corpus, facts, graph, patterns, postings, search, sessions
from siltspark.operators.bundles import import_report
from siltspark.sources.ranged import work_dir
from siltspark.sources.tables import write_archive, write_snapshot


def build_web_corpus(pages: DataFrame, seed_host: str, prefix: str = "/", subdomains: bool = True, excludes: list[str] | None = None) -> dict[str, DataFrame]:
    """Crawled pages as articles, links, assets and stats.

    In-scope pages with a canonical URL that are no block pages, one for each URL (the smallest page_id), cleaned; of
    equal cleaned texts the first stays an article.  Only ids, keys and hashes are sorted, never texts.
    """
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    inside = pages.where(corpus.in_scope(F.col("url"), seed_host, subdomains, prefix, excludes or []) & corpus.block_reason(status, F.coalesce("html", F.lit(""))).isNull())
    keyed = inside.select("page_id", corpus.canonical_url(F.col("url")).alias("url"), "html").where("url is not null")
    firsts = keyed.groupBy("url").agg(F.min("page_id").alias("page_id"))
    kept = keyed.join(firsts.select("page_id"), "page_id", "left_semi")
    clean = corpus.clean_pages(kept).select("page_id", F.col("html").alias("clean"))
    hashes = clean.select("page_id", F.sha2("clean", 256).alias("h"), F.octet_length("clean").cast("long").alias("size"))
    one = hashes.groupBy("h").agg(F.min("page_id").alias("page_id"))
    about = kept.select("page_id", "url", corpus.page_key(F.col("url")).alias("key"), corpus.page_title(F.col("html")).alias("title"))
    articles = about.join(one.select("page_id"), "page_id", "left_semi").join(clean, "page_id")
    links = corpus.resolve_links(corpus.extract_links(kept), kept)
    stats = hashes.agg(F.count("*").alias("pages"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(one.agg(F.count("*").alias("articles")))
    return {"articles": articles, "links": links, "assets": assets.extract_assets(kept), "stats": stats, "snapshot": kept}


def write_web_corpus(built: dict[str, DataFrame], path: str, crawl_id: str, partitions: int | None = None) -> None:
    """The articles as a sorted archive and the pages' snapshot."""
    write_archive(built["articles"].withColumn("ns", F.lit("A")), f"{path}/archive", partitions)
    write_snapshot(built["snapshot"], f"{path}/snapshots", crawl_id)


def recall(messages: DataFrame, memories: DataFrame, query: str, k: int = 10, embedder: Embedder = hashed_terms, pool: int = 50) -> DataFrame:
    """id, preview, score: the messages that a query brings back, and marked memories at 0.5.

    The query's own words decide the way: lexical ranks by full text and fills up with substring matches; the others
    rank those of a pool again by vectors as well.  Only the pool's texts are embedded.  ids are session:turn.
    """
    m = messages.select(F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("id"), "session_id", "turn", "content")
    words = query.lower().split()
    mode = "hybrid" if len(words) > 10 else "vector" if any(w in query.lower() for w in sessions.ABSTRACT) else "lexical"
    full = search.bm25_search(m, "id", "content", query, pool)
    near = search.like_search(m, query, pool).select(F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("id"), "score")
    found = search.fill(full, near, k if mode == "lexical" else pool)
    if mode != "lexical":
        texts = m.join(F.broadcast(found.select("id")), "id", "left_semi")  # a pool of few ids
        asked = embed(messages.sparkSession.createDataFrame([(query,)], "text string"), "text", embedder, name="q").select("q")
        found = search.hybrid_recall(found, embed(texts.select("id", "content"), "content", embedder), asked, k)
    hits = m.join(F.broadcast(found), "id").select("id", sessions.preview(F.col("content")).alias("preview"), "score")
    known = memories.where(F.lower("memory").contains(query.lower()))
    return hits.unionByName(known.select(F.col("memory_id").cast("string").alias("id"), F.concat(F.lit("[Memory] "), sessions.preview(F.col("memory"), 190)).alias("preview"), F.lit(0.5).alias("score")))


def recall_all(messages: DataFrame, queries: DataFrame, memories: DataFrame, k: int = 10, embedder: Embedder = hashed_terms, pool: int = 50, index: str | None = None) -> DataFrame:
    """query_id, id, preview, score: what recall gives, for a table of queries in one job; ids are session:turn.

    queries: ``query_id long, text`` and perhaps ``session_id`` and ``user_id``, which limit those queries that have one to
    its messages (and to the user's memories, where memories have a user_id); all messages count for the weights.  Query
    ids are distinct; a null or blank query brings nothing back.  index: path of a stored index of these messages by id,
    made by add_documents; else one is made in the shared work folder.  Queries that are held as they are in a message
    are found by one automaton over all of them, and only the pools' texts are embedded.
    """
    spark = messages.sparkSession
    folder = work_dir(spark)
    m = messages.select(F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("id"), "session_id", "user_id", "turn", "content", F.octet_length(F.lower("content")).alias("bytes"))
    if index is None:
        index = f"{folder}/index"
        postings.add_documents(m, index, "id", "content")
    limits = [c for c in ("session_id", "user_id") if c in queries.columns]

    def within(hits: DataFrame, columns: list[str]) -> DataFrame:
        """The rows of hits whose columns are what their query is limited to."""
        asked = queries.select("query_id", *[F.col(c).alias(f"_{c}") for c in columns])
        fits = reduce(lambda a, c: a & (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c))), columns, F.lit(True))
        return hits.join(asked, "query_id").where(fits).drop(*asked.columns[1:]) if columns else hits

    def keep(candidates: DataFrame) -> DataFrame:
        about = m.select(F.col("id").alias("key"), *limits)
        return within(candidates.join(about, "key"), limits).select("query_id", "key").distinct() if limits else candidates

    texts = queries.where(F.trim("text") != "").select(F.col("query_id").alias("pattern_id"), F.col("text").alias("pattern"))
    full = postings.search_many(spark, index, queries, pool, keep).select("query_id", F.col("key").alias("id"), "score", F.lit(0).alias("source"))
    near = within(patterns.find_patterns(m, ["id", "session_id", "user_id", "turn", "bytes"], "content", texts).withColumnRenamed("pattern_id", "query_id"), limits)
    newest = W.partitionBy("query_id").orderBy(F.desc("session_id"), F.desc("turn"))
    near = near.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= pool)
    near = near.select("query_id", "id", F.round(F.least(F.lit(1.0), F.col("n") / (F.floor(F.col("bytes") / 100) + 1)), 4).alias("score"), F.lit(1).alias("source"))
    first = full.unionByName(near).groupBy("query_id", "id").agg(F.min_by("score", "source").alias("score"), F.min("source").alias("source"))
    filled = first.join(queries.select("query_id", sessions.route(F.col("text")).alias("mode")), "query_id")
    order = W.partitionBy("query_id").orderBy("source", F.desc("score"), "id")
    filled = filled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("mode") == "lexical", k).otherwise(pool)).drop("r", "source")
    filled.write.parquet(f"{folder}/pools")
    pools = spark.read.schema(filled.schema).parquet(f"{folder}/pools")

    again = pools.where("mode <> 'lexical'").withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    vectors = embed(m.join(postings.small(again.select("id").distinct()), "id", "left_semi").select("id", "content"), "content", embedder).select("id", "vec")
    asked = embed(queries.join(again.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "text"), "text", embedder, name="q").select("query_id", "q")
    cosine = F.coalesce(search.cosine(F.col("vec"), F.col("q")), F.lit(0.0))
    ranked = again.join(vectors, "id", "left").join(asked, "query_id").select("query_id", "id", F.round(0.7 * cosine + 0.3 / F.col("r"), 4).alias("score"))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)
    found = pools.where("mode = 'lexical'").select("query_id", "id", "score").unionByName(ranked.drop("r"))
    texts_of = m.join(postings.small(pools.select("id").distinct()), "id", "left_semi").select("id", sessions.preview(F.col("content")).alias("preview"))
    hits = found.join(texts_of, "id").select("query_id", "id", "preview", "score")

    owned = [c for c in ("user_id",) if c in limits and c in memories.columns]
    known = memories.select(F.col("memory_id").cast("string").alias("id"), *owned, F.concat(F.lit("[Memory] "), sessions.preview(F.col("memory"), 190)).alias("preview"), "memory")
    told = within(patterns.find_patterns(known, ["id", *owned, "preview"], "memory", texts).withColumnRenamed("pattern_id", "query_id"), owned)
    return hits.unionByName(told.select("query_id", "id", "preview", F.lit(0.5).alias("score")))


def curate_memory(messages: DataFrame, memories: DataFrame, most: int, ttl_days: int, now: str) -> dict[str, DataFrame]:
    """New facts, all memories with them, and what stays of these after eviction.

    A fact goes if 60 % of its 30-character windows are in one memory; messages have ``ts`` as their time.  A fact's id
    is its session and turn.
    """
    times = messages.select("session_id", "turn", F.col("ts").alias("updated_at"))
    new = facts.promote_facts(messages).join(times, ["session_id", "turn"])
    new = new.select(F.concat_ws(":", F.lit("fact"), F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("memory_id"), "user_id", F.col("content").alias("memory"), "updated_at", "kind")
    have = memories.select(F.col("memory_id").cast("string").alias("memory_id"), "user_id", "memory", "updated_at")
    told = containment.contained_in(new.select(F.col("memory_id").alias("item_id"), F.col("memory").alias("text")), have.select(F.col("memory_id").alias("doc_id"), F.col("memory").alias("text")))
    fresh = new.join(told.select(F.col("item_id").alias("memory_id")).distinct(), "memory_id", "left_anti")
    every = catalog.upsert(have, fresh.select(*have.columns), "memory_id", "updated_at")
    return {"facts": fresh, "memories": every, "kept": sessions.evict(every, most, ttl_days, now)}


def build_graph(tables: dict[str, tuple[DataFrame, str, dict[str, tuple[str, str]], list[str]]]) -> dict[str, DataFrame]:
    """Triples, stats and report of tables: for each kind its frame, key column, links and property columns."""
    triples = graph.union(*[graph.relations(df, kind, key, links, properties) for kind, (df, key, links, properties) in tables.items()])
    report = import_report({f"rows {kind}": t[0] for kind, t in tables.items()} | {"triples": triples})
    return {"triples": triples, "stats": graph.graph_stats(triples), "report": report}


def catalog_discovery(registries: dict[str, DataFrame], query: str, k: int = 20, tags: list[str] | None = None, semantic: DataFrame | None = None, alpha: float = 0.5, trust: DataFrame | None = None) -> dict[str, DataFrame]:
    """results and facets of a search over several registries' catalogs.

    Each registry gives its k best; an identifier counts once, with its highest score.  semantic: ``id, score`` to fuse;
    trust: ``registry, registry_name, trust``.
    """
    scored = [catalog.catalog_filter(df, tags=tags).withColumns({"score": F.round(catalog.catalog_score(query), 4), "registry": F.lit(name)}) for name, df in registries.items()]
    union = reduce(DataFrame.unionByName, scored).where("score > 0")
    best = catalog.top_per_registry(union, k)
    found = best.groupBy("identifier").agg(F.max("score").alias("score"), F.max_by("registry", "score").alias("registry"))
    if semantic is not None:
        fused = search.fuse(found.select(F.col("identifier").alias("id"), "score"), semantic, alpha)
        found = found.drop("score").join(fused.withColumnRenamed("id", "identifier"), "identifier", "right")
    if trust is not None:
        found = catalog.attach_trust(found, trust)
    return {"results": found, "facets": catalog.facets(union.dropDuplicates(["identifier"]))}


def patch_governance(traces: DataFrame, responses: DataFrame, cooldown_s: int = 600, hours: int = 24, limit: int = 10, least: float = 0.7) -> dict[str, DataFrame]:
    """Patches that may be applied, those that wait, and rejected replies.

    traces: ``event_id, name, ts, success, error_count, quality``; responses: ``event_id, response``.  A patch needs a trace
    worth analysis, confidence, a rest since the name's previous patch and fewer than limit of the trailing hours.
    """
    bad = traces.where("not coalesce(success and error_count = 0 and quality > 0.8, false)").select("event_id", "name", "ts")
    patches, rejects = facts.parse_patches(responses.join(bad, "event_id"))
    sure = patches.where(F.col("confidence") >= least)
    rest = sessions.cooldown_ok(sure, cooldown_s).select("event_id", "ok")
    counted = sessions.rolling_count(sure.withColumn("applied", F.lit(True)), hours, limit).select("event_id", "allowed")
    judged = sure.select("event_id", "name", "ts", "patch", "confidence").join(rest, "event_id").join(counted, "event_id")
    return {"allowed": judged.where("ok and allowed").drop("ok", "allowed"), "waiting": judged.where("not (ok and allowed)"), "rejects": rejects}


def import_tables(tables: dict[str, tuple[DataFrame, str, dict[str, tuple[str, str]], list[str]]], path: str) -> DataFrame:
    """Writes the triples of tables (as build_graph takes them) to path, and gives ``kind, rows, triples, errors``.

    The counts are observed while the triples are written, so each table is read once: its rows, the triples made of
    them, and as errors the rows without a key, of which none are made.  Null links and properties make no triple.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    seen, parts = {}, []
    for kind, (df, key, links, properties) in tables.items():
        seen[kind] = Observation(f"read {kind}"), Observation(f"made {kind}")
        read = df.observe(seen[kind][0], F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("errors"))
        made = graph.relations(read.where(F.col(key).isNotNull()), kind, key, links, properties).where("o is not null")
        parts.append(made.observe(seen[kind][1], F.count(F.lit(1)).alias("triples")))
    graph.union(*parts).write.mode("overwrite").parquet(path)
    # three numbers a table
    rows = [(kind, a.get.get("rows", 0), b.get.get("triples", 0), a.get.get("errors", 0)) for kind, (a, b) in seen.items()]
    return spark.createDataFrame(rows, "kind string, rows long, triples long, errors long")
