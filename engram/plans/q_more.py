"""Smaller queries over the views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import governance as G
from ..operators import graph as KG
from ..operators import oplog as L
from ..operators import storage as S
from .q_graph import T1, T2, _at
from .registry import query
from .views import facts, notes, ops, points, table


@query("SELECT op_id, round(CASE WHEN op_id % 10 = 0 THEN 0 ELSE (1 + op_id % 50) / CAST(op_id % 10 AS DOUBLE) END, 6) AS ratio FROM ops")
def value_ratio(spark, sf):
    size = F.col("op_id") % 10
    return ops(spark, sf).select("op_id", F.round(F.when(size == 0, F.lit(0.0)).otherwise((1 + F.col("op_id") % 50) / size), 6).alias("ratio"))


@query("SELECT op_id FROM (SELECT op_id, row_number() OVER (ORDER BY op_id) - 1 AS i FROM ops) WHERE i >= 3 * 256 AND i < 4 * 256")
def invariant_slice(spark, sf):
    # the fourth window of 256 operations of a log that is numbered without gaps from its first id
    first = ops(spark, sf).agg(F.min("op_id")).first()[0]
    return ops(spark, sf).select("op_id").where((F.col("op_id") - first >= 3 * 256) & (F.col("op_id") - first < 4 * 256))


@query("SELECT o.op_id, p.id, 'upsert' AS kind, CASE WHEN p.sensitivity = 'sensitive' THEN 'sync_after_redaction' WHEN p.collection = 'sensor' THEN 'sync_metadata_only' ELSE 'sync_full' END AS sync_class FROM ops o JOIN points p ON p.id = o.point_id WHERE o.kind = 'upsert' AND p.sensitivity <> 'restricted'")
def record_local(spark, sf):
    p = G.decide(points(spark, sf)).where(G.may_egress()).select("id", "sync_class")
    return ops(spark, sf).where("kind = 'upsert'").select("op_id", F.col("point_id").alias("id"), "kind").join(p, "id")


@query(
    """SELECT o.op_id, CASE WHEN abs(o.wall_ms - 1705000000000) >= 250 THEN 'hlc' WHEN 0.25 >= 0.15 AND o.op_id % 2 = 0 THEN 'trust' WHEN s >= 0.82 THEN 'semantic' ELSE 'human' END AS rung
FROM (SELECT ops.op_id, CASE WHEN ops.op_id % 3 = 0 THEN 1705000000000 + ops.op_id % 100 ELSE ops.wall_ms END AS wall_ms, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s FROM ops JOIN embeddings a ON a.vec_id = ops.point_id JOIN embeddings b ON b.vec_id = ops.op_id % 100) o"""
)
def arbitrate(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    o = ops(spark, sf).withColumn("wall_ms", F.when(F.col("op_id") % 3 == 0, F.lit(1705000000000) + F.col("op_id") % 100).otherwise(F.col("wall_ms")))
    o = o.join(e.toDF("point_id", "mine"), "point_id").withColumn("other", F.col("op_id") % 100).join(e.toDF("other", "theirs"), "other")
    pairs = o.select(
        "op_id", "point_id", F.lit(1705000000000).alias("local_ms"), F.lit(0).alias("local_counter"), F.lit("edge-0").alias("local_node"), F.col("wall_ms").alias("remote_ms"), F.col("counter").alias("remote_counter"),
        F.col("device_id").alias("remote_node"), F.when(F.col("op_id") % 2 == 0, 0.75).otherwise(1.0).alias("trust"), F.round(V.dot(F.col("mine"), F.col("theirs")), 6).alias("similarity"),
    )
    return L.conflict_ladder(pairs).select("op_id", "rung")


_B, _E = "(^|[^a-z0-9_])(", ")([^a-z0-9_]|$)"
_PLANS = {k: v[7:-3] for k, (v, _) in T.ANSWER_PLANS.items()}  # without the flags and word bounds


@query(
    "SELECT id, CASE "
    + " ".join(f"WHEN regexp_matches(lower(q), '{_B}{p}{_E}') THEN '{k}'" for k, p in _PLANS.items())
    + " ELSE '*' END AS collection FROM (SELECT id, text AS q FROM notes) t"
)
def answer_plan(spark, sf):
    return notes(spark, sf).select("id", T.answer_plan(F.col("text"))["collection"].alias("collection"))


@query("SELECT provenance, line_no, valid_from <= TIMESTAMP '1996-06-01' AND TIMESTAMP '1996-06-01' < valid_to AS valid, recorded_at <= TIMESTAMP '1997-06-01' AND (retracted_at IS NULL OR TIMESTAMP '1997-06-01' < retracted_at) AS believed FROM facts")
def fact_axes(spark, sf):
    return facts(spark, sf).select("provenance", "line_no", KG.valid_at(_at(T1)).alias("valid"), KG.believed_at(_at(T2)).alias("believed"))


@query("SELECT id, replace(lower(trim(source)), '  ', ' ') AS source, lang FROM points WHERE source IS NOT NULL")
def canonical_names(spark, sf):
    return points(spark, sf).where("source is not null").select("id", T.canonical(F.col("source")).alias("source"), "lang")


@query("SELECT device_id, count(*) AS n, max(op_id) AS last, CAST(sum(CASE WHEN kind = 'delete' THEN 1 ELSE 0 END) AS BIGINT) AS deletes FROM ops WHERE op_id > 300 GROUP BY device_id")
def log_since(spark, sf):
    return ops(spark, sf).where("op_id > 300").groupBy("device_id").agg(F.count("*").alias("n"), F.max("op_id").alias("last"), F.sum((F.col("kind") == "delete").cast("int")).alias("deletes"))


@query("SELECT point_id, wall_ms FROM (SELECT point_id, max(wall_ms) AS wall_ms FROM ops GROUP BY point_id) ORDER BY wall_ms DESC, point_id LIMIT 30")
def recent_points(spark, sf):
    return ops(spark, sf).groupBy("point_id").agg(F.max("wall_ms").alias("wall_ms")).orderBy(F.desc("wall_ms"), "point_id").limit(30)


@query("SELECT tenant_id, collection, count(*) AS points, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CAST(stale AS INT)) AS BIGINT) AS stale FROM points GROUP BY ROLLUP (tenant_id, collection)")
def tenant_usage(spark, sf):
    return points(spark, sf).rollup("tenant_id", "collection").agg(F.count("*").alias("points"), F.sum(F.length("text")).alias("chars"), F.sum(F.col("stale").cast("int")).alias("stale"))


@query("SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN ts - lag_ts < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_ts FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def user_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT point_id, op_id, prev, op_id - prev AS gap FROM (SELECT point_id, op_id, lag(op_id) OVER (PARTITION BY point_id ORDER BY op_id) AS prev FROM ops) WHERE prev IS NOT NULL")
def operation_gaps(spark, sf):
    w = Window.partitionBy("point_id").orderBy("op_id")
    return ops(spark, sf).select("point_id", "op_id", F.lag("op_id").over(w).alias("prev")).where("prev is not null").withColumn("gap", F.col("op_id") - F.col("prev"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(min(op_id) AS BIGINT) AS low, CAST(max(op_id) AS BIGINT) AS high FROM ops WHERE op_id % 2 = 0")
def migration_guard(spark, sf):
    kept = S.migrate(ops(spark, sf).where("op_id % 2 = 0"), 10)
    return kept.agg(F.count("*").alias("rows"), F.min("op_id").alias("low"), F.max("op_id").alias("high"))
