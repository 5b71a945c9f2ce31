"""Memory-style views over the test tables: points, ops, facts and notes, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant every query takes as now (2024-02-01, seconds), instead of a wall clock.
NOW = 1706745600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e, l = (table(spark, sf_dir, t) for t in ("documents", "embeddings", "labels"))
    i = F.col("doc_id")
    joined = d.join(e, i == F.col("vec_id"), "left").join(l, "doc_id", "left")
    return joined.select(
        i.alias("id"),
        "text",
        "lang",
        "source",
        F.when(i % 4 == 0, "episodic").when(i % 4 == 1, "semantic").when(i % 4 == 2, "procedural").otherwise("sensor").alias("collection"),
        F.concat(F.lit("t"), (i % 3).cast("string")).alias("tenant_id"),
        F.when(i % 5 == 0, "restricted").when(i % 5 == 1, "sensitive").when(i % 5 == 2, "public").otherwise("internal").alias("sensitivity"),
        F.col("embedding").alias("dense"),
        F.col("label").alias("cluster_label"),
        (F.lit(1704067200) + 3600 * i).cast("double").alias("created_at"),
        (F.lit(1704067200) + 3600 * i + 600 * (i % 7)).cast("double").alias("last_access_at"),
        (i % 50).cast("int").alias("access_count"),
        F.when(F.col("quality").isNull(), F.lit(1.0)).otherwise(0.5 + 0.5 * F.col("quality")).cast("double").alias("confidence"),
        (i % 37 == 0).alias("pinned"),
        (i % 29 == 0).alias("stale"),
        F.when(i % 41 == 0, i + 1).alias("superseded_by"),
    )


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("op_id"),
        F.col("user_id").alias("point_id"),
        F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000").alias("wall_ms"),
        (F.col("event_id") % 3).cast("int").alias("counter"),
        F.concat(F.lit("edge-"), (F.col("event_id") % 5).cast("string")).alias("device_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("kind"),
        "value",
        F.col("props").alias("body"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    month = F.expr("INTERVAL 30 DAY")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("subject"),
        F.lit("supplied_by").alias("predicate"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("object"),
        F.col("l_orderkey").alias("provenance"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_shipdate").alias("valid_from"),
        (F.col("l_shipdate") + month).alias("valid_to"),
        F.col("o_orderdate").alias("recorded_at"),
        F.when(F.col("l_returnflag") == "R", F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("retracted_at"),
        (1.0 - F.col("l_discount")).cast("double").alias("confidence"),
    )


#: The words of notes by kind of event (id modulo 6); {v} a measured value, {u} a user, {h} 1 to 9, {b} 0 to 6.
_NOTES = [
    "How do I reset pump {u} after {v} bar in the last {h} hours",
    "average count of trips of spindle {u} at {v}mm/s and {u} rpm",
    "what happened when the valve was open in the past week at {v} Hz",
    "policy threshold limit: {v} bar, above {u} V, rule lifted",
    "Coolant pump at Bay {b} tripped after pressure fell to {v} bar",
    "sensor reading of vibration crossed {v} mm/s, Previous {h} months of logs, valve closed below {u}",
]
_FILL = {"v": "concat(CAST(CAST(floor(value) AS BIGINT) AS STRING), '.5')", "u": "CAST(user_id AS STRING)", "h": "CAST(event_id % 9 + 1 AS STRING)", "b": "CAST(event_id % 7 AS STRING)"}


def _note(words: str) -> str:
    import re

    parts = [x for x in re.split(r"(\{\w\})", words) if x]
    return "concat(" + ", ".join(_FILL[x[1]] if x[0] == "{" else f"'{x}'" for x in parts) + ")"


_NOTE = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {_note(w)}" for i, w in enumerate(_NOTES)) + " END"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: a sentence of measurements and times for each event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(_NOTE).alias("text"))


NOTES_SQL = f"notes AS (SELECT event_id AS id, {_NOTE} AS text FROM events)"

POINTS_SQL = """points AS (SELECT d.doc_id AS id, d.text AS text, d.lang AS lang, d.source AS source,
 CASE d.doc_id % 4 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' ELSE 'sensor' END AS collection,
 concat('t', CAST(d.doc_id % 3 AS STRING)) AS tenant_id,
 CASE d.doc_id % 5 WHEN 0 THEN 'restricted' WHEN 1 THEN 'sensitive' WHEN 2 THEN 'public' ELSE 'internal' END AS sensitivity,
 e.embedding AS dense, e.label AS cluster_label,
 CAST(1704067200 + 3600 * d.doc_id AS DOUBLE) AS created_at,
 CAST(1704067200 + 3600 * d.doc_id + 600 * (d.doc_id % 7) AS DOUBLE) AS last_access_at,
 CAST(d.doc_id % 50 AS INT) AS access_count,
 CAST(CASE WHEN l.quality IS NULL THEN 1.0 ELSE 0.5 + 0.5 * l.quality END AS DOUBLE) AS confidence,
 d.doc_id % 37 = 0 AS pinned, d.doc_id % 29 = 0 AS stale,
 CASE WHEN d.doc_id % 41 = 0 THEN d.doc_id + 1 END AS superseded_by
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

OPS_SQL = """ops AS (SELECT event_id AS op_id, user_id AS point_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS wall_ms,
 CAST(event_id % 3 AS INT) AS counter, concat('edge-', CAST(event_id % 5 AS STRING)) AS device_id,
 CASE event_type WHEN 'error' THEN 'delete' ELSE 'upsert' END AS kind, value, props AS body FROM events)"""

FACTS_SQL = """facts AS (SELECT concat('part:', CAST(l.l_partkey AS STRING)) AS subject, 'supplied_by' AS predicate,
 concat('supplier:', CAST(l.l_suppkey AS STRING)) AS object, l.l_orderkey AS provenance, l.l_linenumber AS line_no,
 l.l_shipdate AS valid_from, l.l_shipdate + INTERVAL 30 DAY AS valid_to, o.o_orderdate AS recorded_at,
 CASE WHEN l.l_returnflag = 'R' THEN o.o_orderdate + INTERVAL 60 DAY END AS retracted_at,
 CAST(1.0 - l.l_discount AS DOUBLE) AS confidence
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

VIEWS = {"points": POINTS_SQL, "ops": OPS_SQL, "facts": FACTS_SQL, "notes": NOTES_SQL}


def with_views(sql: str) -> str:
    """Puts the views a statement names before it; it may begin with further
    ones (", x AS (" or ", RECURSIVE x AS (")."""
    import re

    recursive = "RECURSIVE " if sql.lstrip().startswith(", RECURSIVE ") else ""
    sql = sql.replace(", RECURSIVE ", ", ", 1) if recursive else sql
    used = [text for name, text in VIEWS.items() if re.search(rf"\b{name}\b", sql)]
    if sql.lstrip().startswith(","):
        return "WITH " + recursive + ",\n".join(used) + sql
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + sql
