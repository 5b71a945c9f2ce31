"""Knowledge graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query
from .views import facts, notes, points, table

_T = "TIMESTAMP '1996-06-01'"
_LATE = "TIMESTAMP '1997-06-01'"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


T1, T2 = "1996-06-01 00:00:00", "1997-06-01 00:00:00"
_VALID = f"valid_from <= {_T} AND {_T} < valid_to"
_BELIEVED = "recorded_at <= {0} AND (retracted_at IS NULL OR {0} < retracted_at)"


@query(f", l AS (SELECT * FROM facts WHERE {_VALID} AND {_BELIEVED.format(_T)}) SELECT (SELECT count(*) FROM l) AS facts, (SELECT count(DISTINCT e) FROM (SELECT subject AS e FROM l UNION ALL SELECT object FROM l)) AS entities".replace("SELECT * FROM facts", "SELECT * FROM facts"))
def facts_as_of(spark, sf):
    return G.as_of(facts(spark, sf), _at(T1), _at(T1))


@query(f"SELECT provenance, line_no FROM facts WHERE {_VALID} AND {_BELIEVED.format(_LATE)}")
def facts_live(spark, sf):
    return G.live(facts(spark, sf), _at(T1), _at(T2)).select("provenance", "line_no")


@query(
    f""", b AS (SELECT provenance, line_no, {_BELIEVED.format(_T)} AS a, {_BELIEVED.format(_LATE)} AS b FROM facts)
SELECT CASE WHEN b AND NOT a THEN 'learned' WHEN a AND NOT b THEN 'retracted' ELSE 'stable' END AS change, count(*) AS n FROM b WHERE a OR b GROUP BY change"""
)
def facts_diff(spark, sf):
    return G.diff(facts(spark, sf), _at(T1), _at(T2), ["provenance", "line_no"]).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT subject, object, provenance, line_no FROM facts WHERE subject IN ('part:5', 'part:9') OR object IN ('supplier:1')")
def facts_neighbours(spark, sf):
    front = spark.createDataFrame([("part:5",), ("part:9",), ("supplier:1",)], "entity string")
    return G.neighbours(facts(spark, sf), front).select("subject", "object", "provenance", "line_no")


_ADJ = "adj AS (SELECT src, dst, max(confidence) AS c FROM (SELECT subject AS src, object AS dst, confidence FROM facts UNION ALL SELECT object, subject, confidence FROM facts) GROUP BY src, dst)"


@query(f", {_ADJ} SELECT src, dst, round(c, 4) AS confidence FROM adj WHERE (SELECT count(*) FROM facts) > 0")
def facts_adjacency(spark, sf):
    return G.adjacency(facts(spark, sf)).withColumn("confidence", F.round("confidence", 4))


@query(
    f""", {_ADJ}, p2 AS (SELECT a.src, b.dst, 2 AS hops, concat_ws('>', a.src, a.dst, b.dst) AS path, round(a.c * b.c, 6) AS confidence FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src = 'part:1' AND b.dst <> a.src)
SELECT * FROM p2 WHERE (SELECT count(*) FROM facts) > 0 UNION ALL SELECT src, dst, 1, concat_ws('>', src, dst), round(c, 6) FROM adj WHERE src = 'part:1'"""
)
def facts_paths_2hop(spark, sf):
    seed = spark.createDataFrame([("part:1",)], "entity string")
    p = G.paths(G.adjacency(facts(spark, sf)), seed, 2)
    return p.select("src", "dst", "hops", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


@query(
    """SELECT src, dst, hops, array_to_string(path, '>') AS path, round(confidence, 6) AS confidence FROM (WITH RECURSIVE w AS (SELECT subject, object, confidence FROM facts WHERE valid_from >= TIMESTAMP '1995-03-01' AND valid_from < TIMESTAMP '1995-03-15'),
adj AS (SELECT src, dst, max(confidence) AS c FROM (SELECT subject AS src, object AS dst, confidence FROM w UNION ALL SELECT object, subject, confidence FROM w) GROUP BY src, dst),
r AS (SELECT src, dst, 1 AS hops, [src, dst] AS path, c AS confidence FROM adj WHERE src LIKE 'supplier:%' UNION ALL SELECT r.src, adj.dst, hops + 1, list_append(path, adj.dst), r.confidence * adj.c FROM r JOIN adj ON adj.src = r.dst WHERE hops < 4 AND NOT list_contains(path, adj.dst))
SELECT * FROM r)"""
)
def facts_paths_4hop(spark, sf):
    """All simple paths from any supplier over what was supplied in two weeks."""
    f = facts(spark, sf).where("valid_from >= TIMESTAMP_NTZ '1995-03-01' and valid_from < TIMESTAMP_NTZ '1995-03-15'")
    edges = G.adjacency(f)
    seeds = edges.where("src like 'supplier:%'").select(F.col("src").alias("entity")).distinct()
    p = G.paths(edges, seeds, 4)
    return p.select("src", "dst", "hops", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


@query(
    f""", {_ADJ}, s1 AS (SELECT dst AS e, max(0.55 * c) AS x FROM adj WHERE src = 'part:1' GROUP BY dst HAVING max(0.55 * c) > 0.02), s2 AS (SELECT adj.dst AS e, max(x * 0.55 * c) AS x FROM s1 JOIN adj ON adj.src = s1.e GROUP BY adj.dst HAVING max(x * 0.55 * c) > 0.02)
SELECT e AS entity, round(max(x), 6) AS energy FROM (SELECT 'part:1' AS e, CAST(1.0 AS DOUBLE) AS x UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) WHERE (SELECT count(*) FROM facts) > 0 GROUP BY e"""
)
def spreading_activation(spark, sf):
    seed = spark.createDataFrame([("part:1", 1.0)], "entity string, energy double")
    return G.spreading_activation(G.adjacency(facts(spark, sf)), seed).withColumn("energy", F.round("energy", 6))


@query(
    """, f AS (SELECT subject, object, min(valid_from) AS valid_from, count(DISTINCT provenance) AS n, arg_min(confidence, {'a': recorded_at, 'b': provenance, 'c': line_no, 'd': confidence}) AS c FROM facts GROUP BY subject, predicate, object)
SELECT subject, object, CAST(valid_from AS VARCHAR) AS valid_from, n, round(greatest(c, least(0.99, c + 0.03 * n * (n - 1) / 2)), 6) AS confidence FROM f"""
)
def corroborate_facts(spark, sf):
    c = G.corroborate(facts(spark, sf))
    return c.select("subject", "object", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"), "n", F.round("confidence", 6).alias("confidence"))


@query("SELECT predicate, count(*) AS facts, count(*) FILTER (WHERE retracted_at IS NULL) AS live, count(DISTINCT subject) AS subjects FROM facts GROUP BY predicate")
def graph_snapshot(spark, sf):
    return facts(spark, sf).groupBy("predicate").agg(F.count("*").alias("facts"), F.count_if(F.col("retracted_at").isNull()).alias("live"), F.count_distinct("subject").alias("subjects"))


@query(f"SELECT count(*) FILTER (WHERE retracted_at IS NOT NULL OR object = 'supplier:3') AS retracted, count(*) FILTER (WHERE retracted_at IS NULL AND object = 'supplier:3') AS now FROM facts")
def facts_retract(spark, sf):
    f = facts(spark, sf).withColumn("open", F.col("retracted_at").isNull())
    key = ["subject", "object", "provenance", "line_no"]
    done = G.retract(f, f.where("object = 'supplier:3'").select(*key), key, _at(T2))
    return done.agg(F.count_if(F.col("retracted_at").isNotNull()).alias("retracted"), F.count_if(F.col("open") & F.col("retracted_at").isNotNull()).alias("now"))


@query(
    """, f AS (SELECT concat(subject, '|', object) AS fact_id, list(DISTINCT provenance) AS p FROM facts GROUP BY subject, object), g AS (SELECT fact_id, p, list_filter(p, lambda x: x % 4 <> 0) AS k FROM f)
SELECT fact_id, len(k) AS kept, len(k) = 0 AS retracted FROM g"""
)
def forget_points(spark, sf):
    f = facts(spark, sf).groupBy(F.concat("subject", F.lit("|"), "object").alias("fact_id")).agg(F.collect_set("provenance").alias("provenance")).withColumn("retracted_at", F.lit(None).cast("timestamp_ntz"))
    dead = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("point"))
    done = G.forget(f, dead, _at(T2))
    return done.select("fact_id", F.size("provenance").cast("long").alias("kept"), F.col("retracted_at").isNotNull().alias("retracted"))


@query("SELECT id, CASE WHEN id % 10 = 3 THEN id + 1 ELSE superseded_by END AS superseded_by, round(CASE WHEN id % 10 = 3 THEN confidence * 0.5 ELSE confidence END, 4) AS confidence FROM points")
def supersede_points(spark, sf):
    p = points(spark, sf).select("id", "superseded_by", "confidence")
    pairs = p.where("id % 10 = 3").select("id", (F.col("id") + 1).alias("winner"))
    return G.supersede(p, pairs).select("id", "superseded_by", F.round("confidence", 4).alias("confidence"))


@query("SELECT provenance AS id, count(*) AS mentions FROM (SELECT subject AS e, provenance FROM facts UNION ALL SELECT object, provenance FROM facts) WHERE e IN ('part:1', 'part:2', 'supplier:2') GROUP BY provenance")
def points_for_entities(spark, sf):
    f = facts(spark, sf)
    m = f.select(F.col("subject").alias("entity"), F.col("provenance").alias("id")).union(f.select("object", "provenance"))
    return G.points_for_entities(m, spark.createDataFrame([("part:1",), ("part:2",), ("supplier:2",)], "entity string"))


@query("SELECT subject AS entity, count(*) AS mentions FROM facts GROUP BY subject ORDER BY mentions DESC, entity LIMIT 20")
def entities_by_mentions(spark, sf):
    return facts(spark, sf).groupBy(F.col("subject").alias("entity")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity").limit(20)


@query()
def extract_facts(spark, sf):
    return G.extract_facts(notes(spark, sf)).select("id", "subject", "object", "predicate")


@query()
def extract_entities(spark, sf):
    return G.extract_entities(notes(spark, sf)).groupBy("entity", "kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("points"))
