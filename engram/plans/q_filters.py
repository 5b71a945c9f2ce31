"""Filters, predicates and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as O
from .registry import query
from .views import NOW, notes, ops, points, table


@query("SELECT id, collection FROM points WHERE collection IN ('episodic','sensor') AND access_count >= 10 AND (sensitivity = 'public' OR pinned) AND NOT (stale = TRUE) AND NOT coalesce(cluster_label = 3, FALSE)")
def filter_tree(spark, sf):
    spec = {
        "must": [{"field": "collection", "op": "in", "value": ["episodic", "sensor"]}, {"field": "access_count", "op": "gte", "value": 10}],
        "should": [{"field": "sensitivity", "value": "public"}, {"field": "pinned", "value": True}],
        "must_not": [{"field": "stale", "value": True}, {"field": "cluster_label", "value": 3}],
    }
    return O.Filter.parse(spec).apply(points(spark, sf)).select("id", "collection")


@query("SELECT id FROM points WHERE collection = 'semantic' AND source IN ('src1','src2','src3') AND access_count >= 5 AND access_count < 40")
def filter_shorthand(spark, sf):
    return O.Filter.parse({"collection": "semantic", "source": ["src1", "src2", "src3"], "access_count": {"gte": 5, "lt": 40}}).apply(points(spark, sf)).select("id")


@query(
    """, p AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN CAST(id AS VARCHAR) ELSE 'not-a-number' END AS ts FROM points)
SELECT id, coalesce(cluster_label <> 3, FALSE) AS ne_label, coalesce(TRY_CAST(ts AS DOUBLE) > 100, FALSE) AS gt_text, ts IS NOT NULL AS has_ts, FALSE AS absent_eq, TRUE AS absent_missing,
 coalesce(access_count BETWEEN 5 AND 20, FALSE) AS in_range, contains(source, '1') AS has_one FROM p"""
)
def filter_missing_field(spark, sf):
    p = points(spark, sf).withColumn("ts", F.when(F.col("id") % 3 == 1, F.col("id").cast("string")).when(F.col("id") % 3 == 2, "not-a-number"))
    C = O.Condition
    tests = {
        "ne_label": C("cluster_label", "ne", 3),
        "gt_text": C("ts", "gt", 100),
        "has_ts": C("ts", "exists", True),
        "absent_eq": C("nowhere", "eq", 1),
        "absent_missing": C("nowhere", "exists", False),
        "in_range": C("access_count", "range", (5, 20)),
        "has_one": C("source", "contains", "1"),
    }
    return p.select("id", *[c.column(p).alias(k) for k, c in tests.items()])


@query(
    """SELECT round(avg(CAST(collection = 'sensor' AS INT)), 6) AS sensor, round(avg(CAST(access_count >= 25 AS INT)), 6) AS busy,
 round(avg(CAST(coalesce(cluster_label = 2, FALSE) AS INT)), 6) AS labelled, round(avg(CAST(collection = 'sensor' AS INT)) * avg(CAST(access_count >= 25 AS INT)), 6) AS independent FROM points"""
)
def filter_selectivity(spark, sf):
    p = points(spark, sf)
    s = O.selectivity(p, {"sensor": O.Condition("collection", "eq", "sensor"), "busy": O.Condition("access_count", "gte", 25), "labelled": O.Condition("cluster_label", "eq", 2)})
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns], F.round(F.col("sensor") * F.col("busy"), 6).alias("independent"))


@query(
    """, n AS (SELECT count(*) AS corpus, count(*) FILTER (WHERE sensitivity = 'restricted' AND collection = 'sensor') AS matches FROM points)
SELECT corpus, matches, CASE WHEN matches = 0 THEN 'empty' WHEN matches + 0.04 <= least(corpus * 0.06 + 0.15 * least(corpus, greatest(10, CAST(floor(10 / greatest(matches / corpus, 0.001)) AS BIGINT))), corpus * 1.15) THEN 'pre_filter'
 WHEN corpus * 0.06 + 0.15 * least(corpus, greatest(10, CAST(floor(10 / greatest(matches / corpus, 0.001)) AS BIGINT))) <= corpus * 1.15 THEN 'post_filter' ELSE 'full_scan' END AS plan FROM n"""
)
def query_plan(spark, sf):
    p = points(spark, sf)
    f = O.Filter.parse({"sensitivity": "restricted", "collection": "sensor"})
    r = p.agg(F.count("*").alias("corpus"), F.count_if(f.column(p)).alias("matches")).first()
    chosen = O.plan(r.corpus, 10, True, matches=r.matches, conditions=2)
    return spark.createDataFrame([(r.corpus, r.matches, chosen.kind)], "corpus long, matches long, plan string")


@query("SELECT l_returnflag, l_linestatus, CAST(40 * count(*) AS BIGINT) AS corpus, CASE WHEN 40 * count(*) < 110000 THEN 'flat' WHEN 40 * count(*) < 1000000 THEN 'hnsw' ELSE 'ivf_pq' END AS strategy FROM lineitem GROUP BY l_returnflag, l_linestatus")
def index_strategy(spark, sf):
    """Forty times each group's rows, as a corpus."""
    n = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((40 * F.count("*")).cast("long").alias("corpus"))
    return n.withColumn("strategy", O.strategy_of(F.col("corpus")))


@query("WITH c AS (SELECT event_type, round(avg(value), 3) AS flat FROM events GROUP BY event_type) SELECT event_type, (SELECT min(n) FROM (SELECT CAST(unnest(range(10000, 20000001, 10000)) AS BIGINT) AS n) WHERE 64 * 5.6 * log2(n) * 9000.0 * 1.5 < n * flat OR n = 20000000) AS crossover FROM c")
def index_crossover(spark, sf):
    """Each kind of event's mean value as the cost of a scanned row."""
    c = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("flat"))
    return c.select("event_type", O.crossover_at(F.col("flat"), F.lit(9000.0)).alias("crossover"))


@query("SELECT id, concat_ws('::', tenant_id, collection) AS namespace FROM points WHERE tenant_id = 't1' AND superseded_by IS NULL")
def tenant_rls(spark, sf):
    p = O.live(O.visible(points(spark, sf), "t1"))
    return p.select("id", O.namespace(F.col("tenant_id"), F.col("collection")).alias("namespace"))


@query("SELECT id, lang FROM points WHERE id = 36 AND tenant_id = 't0'")
def point_lookup(spark, sf):
    return O.visible(points(spark, sf), "t0").where("id = 36").select("id", "lang")


@query("SELECT id FROM points WHERE collection = 'procedural' INTERSECT SELECT id FROM points WHERE sensitivity IN ('public','internal')")
def posting_intersect(spark, sf):
    p = points(spark, sf)
    return p.where("collection = 'procedural'").select("id").intersect(p.where(F.col("sensitivity").isin("public", "internal")).select("id"))


@query(f"SELECT id, round({NOW} - created_at, 3) AS age_s, (created_at + 86400 * 20 < {NOW} AND NOT pinned) AS expired FROM points")
def expiry(spark, sf):
    p, ttl = points(spark, sf), 86400.0 * 20
    age = F.lit(NOW) - F.col("created_at")
    return p.select("id", F.round(age, 3).alias("age_s"), ((age > ttl) & ~F.col("pinned")).alias("expired"))


@query(
    """SELECT id, CAST(CASE WHEN regexp_extract(q, '(?i)\\b(?:last|past|previous)\\s+(\\d+)?\\s*(second|minute|hour|day|week|month)s?\\b', 2) = '' THEN NULL ELSE
 CASE WHEN regexp_extract(q, '(?i)\\b(?:last|past|previous)\\s+(\\d+)?\\s*(second|minute|hour|day|week|month)s?\\b', 1) = '' THEN 1 ELSE CAST(regexp_extract(q, '(?i)\\b(?:last|past|previous)\\s+(\\d+)?\\s*(second|minute|hour|day|week|month)s?\\b', 1) AS INT) END *
 CASE lower(regexp_extract(q, '(?i)\\b(?:last|past|previous)\\s+(\\d+)?\\s*(second|minute|hour|day|week|month)s?\\b', 2)) WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 ELSE 2592000 END END AS INT) AS seconds
FROM (SELECT id, text AS q FROM notes) t"""
)
def temporal_filter(spark, sf):
    from ..functions.text import relative_seconds

    return notes(spark, sf).select("id", relative_seconds(F.col("text")).alias("seconds"))


_KEYS = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN ['read'] WHEN 1 THEN ['admin'] ELSE ['write', 'read'] END AS s FROM customer"


@query(
    """SELECT f AS feature, count(*) FILTER (WHERE op_id % 6 < r) AS allowed, count(*) AS n FROM ops, (VALUES ('triton_escalation',1),('wide_fetch',1),('graph_boost',1),('late_interaction',2),('adapter',2),('query_understanding',2),('cross_encoder',3),('diversity',3),('sparse',4),('background_maintenance',4)) t(f, r) GROUP BY f"""
)
def feature_gate(spark, sf):
    """Of each feature the requests that may use it, at the level each finds."""
    from ..operators.metrics import allowed_at

    o = ops(spark, sf).select((F.col("op_id") % 6).alias("level"))
    asked = o.select("level", F.explode(allowed_at(F.col("level"))).alias("x"))
    return asked.groupBy(F.col("x.feature").alias("feature")).agg(F.count_if("x.allowed").alias("allowed"), F.count("*").alias("n"))


@query(f"SELECT id, sc AS scope, (list_contains(s, 'admin') OR list_contains(s, sc)) AS ok FROM ({_KEYS}) k, (VALUES ('read'), ('write')) w(sc)")
def scope_check(spark, sf):
    k = F.col("c_custkey")
    keys = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, F.array(F.lit("read"))).when(k % 3 == 1, F.array(F.lit("admin"))).otherwise(F.array(F.lit("write"), F.lit("read"))).alias("s"))
    wanted = F.explode(F.array(F.lit("read"), F.lit("write"))).alias("scope")
    return keys.select("id", "s", wanted).select("id", "scope", (F.array_contains("s", "admin") | F.array_contains(F.col("s"), F.col("scope"))).alias("ok"))
