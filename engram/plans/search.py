"""Composed plans: hybrid search with explanations, question answering, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contradiction, filters, governance, graph, metrics
from ..operators import retrieval as R


def query_terms(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, term, weight of query texts (query_id, text): terms weigh as in the index's
    heaviest use, unknown terms not at all."""
    t = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    known = index.groupBy("term").agg(F.max("weight").alias("weight"))
    return t.join(known, "term").select("query_id", "term", "weight")


def search(
    points: DataFrame,
    index: DataFrame,
    queries: DataFrame,
    now: float,
    k: int = 5,
    spec: dict | None = None,
    tenant: str | None = None,
    level: int = 0,
    mentions: DataFrame | None = None,
    gap: float = 0.1,
) -> DataFrame:
    """Hybrid retrieval of a set of queries (query_id, text, q) in one plan: filters and tenancy,
    dense and sparse ranks, fusion, score, graph boost, diversity, and the calibrated set. Each
    stage's columns stay: they explain the rank. level sheds stages. Filters always apply."""
    fetch = max(6 * k, 24) if metrics.allows("wide_fetch", level) else max(2 * k, 10)
    allowed = filters.visible(filters.Filter.parse(spec).apply(points), tenant)
    ids = allowed.select("id")
    dense = R.top_k(R.nearest(allowed, queries.select("query_id", "q"), fetch), fetch, ["query_id"])
    if metrics.allows("sparse", level):
        sparse = R.top_k(R.sparse_nearest(index.join(ids, "id", "left_semi"), query_terms(queries, index), fetch), fetch, ["query_id"])
    else:
        sparse = dense.where(F.lit(False))
    fused = R.top_k(R.reciprocal_rank_fusion(dense, sparse, ["query_id"]), max(3 * k, 12), ["query_id"], score="rrf", rank="fused_rank")
    rows = fused.join(allowed.select("id", "dense", "last_access_at", "access_count", "confidence", "pinned", "stale", "superseded_by"), "id")
    scored = rows.withColumn("f", R.final_score(F.least(F.lit(1.0), F.col("rrf") * 60), now)).select("*", "f.recency", "f.salience", "f.score").drop("f")
    if mentions is not None and metrics.allows("graph_boost", level):
        scored = R.graph_boost(scored, mentions, ["query_id"]).withColumn("score", F.col("score") + F.col("graph_boost"))
    else:
        scored = scored.withColumn("graph_boost", F.lit(0.0))
    if metrics.allows("diversity", level):
        kept = R.mmr(scored.where(F.col("dense").isNotNull()).select("query_id", "id", "score", "dense"), "query_id", k)
        scored = scored.join(kept, ["query_id", "id"], "left").where(F.col("pick").isNotNull() | F.col("dense").isNull())
    else:
        scored = scored.withColumn("pick", F.lit(None).cast("int"))
    best = R.top_k(scored.drop("dense"), k, ["query_id"])
    top = F.max("score").over(Window.partitionBy("query_id"))
    return best.withColumn("in_set", top - F.col("score") <= gap)


def search_relaxed(points: DataFrame, index: DataFrame, queries: DataFrame, now: float, inferred: dict, asked: dict | None = None, **options) -> DataFrame:
    """search() under what the question implies; queries without a hit are asked again within
    the caller's own filters, which are never given up."""
    narrow = search(points, index, queries, now, spec={**(asked or {}), **inferred}, **options)
    missed = queries.join(narrow.select("query_id").distinct(), "query_id", "left_anti")
    return narrow.withColumn("relaxed", F.lit(False)).unionByName(search(points, index, missed, now, spec=asked, **options).withColumn("relaxed", F.lit(True)))


def answer(points: DataFrame, hits: DataFrame, cite: int = 3) -> DataFrame:
    """query_id, answer (the best hit's first sentence), citations, contradicted, confidence."""
    texts = hits.join(points.select("id", "text", "created_at", "superseded_by"), "id")
    against = contradiction.contradictions(texts.select("id", "text", "created_at", F.lit(None).cast("long").alias("superseded_by")).distinct())
    ids = against.select(F.col("older").alias("id")).union(against.select("newer")).distinct().withColumn("against", F.lit(True))
    per = texts.join(ids, "id", "left").groupBy("query_id").agg(
        F.max("score").alias("top"),
        F.max_by("text", F.struct("score", -F.col("id"))).alias("text"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("score", "id")), asc=False), lambda x: x["id"]), 1, cite).alias("citations"),
        F.coalesce(F.max("against"), F.lit(False)).alias("contradicted"),
    )
    confidence = F.least(F.lit(0.99), F.col("top") * F.when(F.col("contradicted"), 0.75).otherwise(1.0))
    return per.select("query_id", F.regexp_extract("text", r"^\s*([^.!?\n]*[.!?]?)", 1).alias("answer"), "citations", "contradicted", confidence.alias("confidence"))


def ingest(rows: DataFrame, known: DataFrame | None = None, quota: int | None = None) -> dict[str, DataFrame]:
    """What one batch of texts (id, text, collection, source, tenant_id, confidence, ts) becomes:
    points with class and policy, terms, facts. Rows beyond a tenant's quota are left out."""
    batch = rows.dropDuplicates(["id"])
    if known is not None:
        batch = batch.join(known.select("id"), "id", "left_anti")
    if quota is not None:
        used = 0 if known is None else F.coalesce("used", F.lit(0))
        if known is not None:
            batch = batch.join(known.groupBy("tenant_id").agg(F.count("*").alias("used")), "tenant_id", "left")
        w = Window.partitionBy("tenant_id").orderBy("ts", "id")
        batch = batch.withColumn("_n", F.row_number().over(w)).where(F.col("_n") + used <= quota).drop("_n", "used")
    classed = batch.withColumn("_c", governance.classify(F.col("text"))).select("*", "_c.sensitivity", "_c.signals").drop("_c")
    points = governance.decide(classed)
    return {"points": points, "terms": R.bm25(batch.select("id", "text")), "facts": graph.extract_facts(batch)}
