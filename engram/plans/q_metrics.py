"""Maintenance sweeps, statistics, objectives and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..operators import maintenance as M
from ..operators import metrics as X
from .registry import query
from .views import NOW, ops, points, table

_SAL = "CASE WHEN pinned THEN CAST('inf' AS DOUBLE) ELSE pow(CAST(0.5 AS DOUBLE), greatest(0, 1704500000.0 - last_access_at) / 21600.0) * (1.0 + ln(1.0 + access_count)) * greatest(confidence, 0.05) END"
_EXP = "(created_at + 86400 < 1704500000.0 AND NOT pinned AND id % 3 = 0)"
_TIER = f", r AS (SELECT id, {_EXP} AS expired, row_number() OVER (ORDER BY {_SAL} DESC, id) AS rn FROM points), pl AS (SELECT id, CASE WHEN expired THEN 'evicted' WHEN rn <= 50 THEN 'hot' WHEN rn <= 150 THEN 'warm' ELSE 'cold' END AS tier FROM r)"


def _plan(spark, sf):
    p = points(spark, sf)
    expired = (F.col("created_at") + 86400 < 1704500000.0) & ~F.col("pinned") & (F.col("id") % 3 == 0)
    return M.tier_plan(p, 1704500000.0, 50, 100, expired)


@query(_TIER + " SELECT id, tier FROM pl WHERE (SELECT count(*) FROM points) > 0")
def tier_plan(spark, sf):
    return _plan(spark, sf)


_CUR = "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END"
_RK = "list_position(['hot','warm','cold','evicted'], {0})"


@query(
    _TIER
    + f", c AS (SELECT pl.id, tier, {_CUR.replace('id', 'pl.id')} AS old FROM pl, (SELECT 1 FROM points LIMIT 1)) SELECT count(*) FILTER (WHERE tier <> 'evicted' AND {_RK.format('tier')} < {_RK.format('old')}) AS promoted, count(*) FILTER (WHERE tier <> 'evicted' AND {_RK.format('tier')} > {_RK.format('old')}) AS demoted, count(*) FILTER (WHERE tier = 'evicted') AS evicted, count(*) AS scanned FROM c"
)
def compaction_report(spark, sf):
    cur = points(spark, sf).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm").otherwise("cold").alias("tier"))
    return M.compaction_report(cur, _plan(spark, sf))


@query(
    f""", f AS (SELECT *, CASE WHEN pinned THEN 1.0 ELSE round(pow(CAST(0.5 AS DOUBLE), greatest(0, {NOW} - last_access_at) / (21 * 86400.0)) * greatest(confidence, 0.1), 6) END AS freshness, id % 31 = 0 AND NOT pinned AS expired FROM points)
SELECT id, CAST(floor(freshness * 1000 + 1e-6) AS BIGINT) AS freshness, CASE WHEN expired THEN 'expired' WHEN freshness < 0.45 AND NOT stale THEN 'marked' WHEN freshness >= 0.45 AND stale THEN 'revived' ELSE 'kept' END AS change FROM f"""
)
def freshness_sweep(spark, sf):
    p = points(spark, sf)
    s = M.freshness_sweep(p, M.freshness(NOW, F.col("last_access_at")), (F.col("id") % 31 == 0) & ~F.col("pinned"), 0.45)
    return s.select("id", F.floor(F.col("freshness") * 1000 + 1e-6).alias("freshness"), "change")


@query("SELECT CASE WHEN collection IS NOT NULL THEN 'collection' WHEN sensitivity IS NOT NULL THEN 'sensitivity' WHEN tenant_id IS NOT NULL THEN 'tenant_id' ELSE 'lang' END AS key, coalesce(collection, sensitivity, tenant_id, lang) AS value, count(*) AS n FROM points GROUP BY GROUPING SETS ((collection), (sensitivity), (tenant_id), (lang))")
def memory_stats(spark, sf):
    return M.stats(points(spark, sf), ["collection", "sensitivity", "tenant_id", "lang"])


@query(_TIER + ", t AS (SELECT unnest(['hot','warm','cold','evicted','archived']) AS tier) SELECT t.tier, count(pl.id) AS n FROM t LEFT JOIN pl ON pl.tier = t.tier WHERE (SELECT count(*) FROM points) > 0 GROUP BY t.tier")
def tier_counts(spark, sf):
    domain = spark.createDataFrame([(t,) for t in (*M.TIERS, "archived")], "tier string")
    return M.zero_filled(_plan(spark, sf).groupBy("tier").agg(F.count("*").alias("n")), domain, "tier")


@query("SELECT 'collection' AS field, count(DISTINCT collection) AS n FROM points UNION ALL SELECT 'source', count(DISTINCT source) FROM points UNION ALL SELECT 'access_count', count(DISTINCT access_count) FROM points")
def field_cardinality(spark, sf):
    return M.cardinality(points(spark, sf), ["collection", "source", "access_count"])


@query(
    """WITH c AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL), v AS (SELECT label, list(x ORDER BY p) AS c FROM c GROUP BY label)
SELECT e.label, arg_max(e.vec_id, {'d': round(list_dot_product(CAST(e.embedding AS DOUBLE[]), v.c), 9), 'i': -e.vec_id}) AS id, count(*) AS n FROM embeddings e JOIN v ON v.label = e.label GROUP BY e.label"""
)
def cluster_medoid(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return M.medoid(v, "label")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45")
def similar_pairs(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return M.similar_pairs(v, 0.45, "label").withColumn("score", F.round("score", 5))


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.38),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach), m AS (SELECT id, min(reach) AS cluster FROM r GROUP BY id)
SELECT id, cluster FROM m QUALIFY count(*) OVER (PARTITION BY cluster) >= 3""")
def near_duplicate_clusters(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    return M.clusters(M.similar_pairs(v, 0.38, "label"))


@query(
    """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, round(avg(value), 6) AS mean, round(max(value) FILTER (WHERE i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT))), 6) AS p50, round(max(value) FILTER (WHERE i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))), 6) AS p95, round(max(value) FILTER (WHERE i = least(n - 1, CAST(floor(0.99 * n) AS BIGINT))), 6) AS p99 FROM v GROUP BY event_type, n"""
)
def latency_quantiles(spark, sf):
    h = X.histogram(table(spark, sf, "events").select("event_type", "value"), "event_type", "value")
    return h.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("SELECT event_type, count(*) AS n, round((sum(CAST(value > 150 AS INT)) + sum(CAST(event_id % 50 = 0 AS INT))) / CAST(count(*) AS DOUBLE) / 0.005, 4) AS burn_rate, round(avg(CAST(event_id % 50 <> 0 AS INT)), 6) AS success_rate FROM events GROUP BY event_type")
def slo_burn_rate(spark, sf):
    e = table(spark, sf, "events")
    b = X.burn_rate(e, ["event_type"], F.col("value"), F.col("event_id") % 50 != 0)
    return b.select("event_type", "n", F.round("burn_rate", 4).alias("burn_rate"), F.round("success_rate", 6).alias("success_rate"))


@query(
    """WITH l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 64), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l)
SELECT event_type, round(value, 6) AS p95 FROM r WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT)"""
)
def route_p95(spark, sf):
    last = X.last_n(table(spark, sf, "events").select("event_type", "value", "event_id"), ["event_type"], [F.desc("event_id")], 64)
    return X.quantile_rank(last, ["event_type"], "value", {"p95": F.floor(F.lit(0.95) * (F.col("n") - 1))}).select("event_type", F.round("p95", 6).alias("p95"))


_SP = "sp AS (SELECT event_id AS span_id, event_id // 8 AS trace_id, CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 8 < 4 THEN event_id - event_id % 8 ELSE event_id - event_id % 8 + event_id % 8 - 3 END AS parent_id, event_type AS name, CASE WHEN event_id % 8 = 0 THEN value + 1000 ELSE value END AS ms FROM events)"


def _spans(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id") % 8
    parent = F.when(i == 0, None).when(i < 4, F.col("event_id") - i).otherwise(F.col("event_id") - 3)
    return e.select(F.col("event_id").alias("span_id"), F.expr("event_id DIV 8").alias("trace_id"), parent.alias("parent_id"), F.col("event_type").alias("name"), F.when(i == 0, F.col("value") + 1000).otherwise(F.col("value")).alias("ms"))


_OWN = f"{_SP}, ch AS (SELECT parent_id AS p, sum(ms) AS c FROM sp WHERE parent_id IS NOT NULL GROUP BY parent_id), own AS (SELECT sp.*, greatest(0, ms - coalesce(c, 0)) AS self_ms FROM sp LEFT JOIN ch ON ch.p = sp.span_id)"


@query(f"WITH {_OWN} SELECT span_id, round(self_ms, 4) AS self_ms FROM own")
def span_self_time(spark, sf):
    return X.self_time(_spans(spark, sf)).select("span_id", F.round("self_ms", 4).alias("self_ms"))


@query(f"WITH {_OWN}, roots AS (SELECT trace_id, ms FROM own WHERE parent_id IS NULL ORDER BY ms DESC, trace_id LIMIT 20) SELECT r.trace_id, round(r.ms, 4) AS total_ms, arg_max(o.name, {{'s': o.self_ms, 'i': -o.span_id}}) AS hotspot FROM roots r JOIN own o ON o.trace_id = r.trace_id GROUP BY ALL")
def slowest_traces(spark, sf):
    return X.slowest(_spans(spark, sf), 20).select("trace_id", F.round("total_ms", 4).alias("total_ms"), "hotspot")


@query(f"WITH RECURSIVE {_SP}, t AS (SELECT span_id, trace_id, 0 AS depth FROM sp WHERE parent_id IS NULL UNION ALL SELECT s.span_id, s.trace_id, t.depth + 1 FROM t JOIN sp s ON s.parent_id = t.span_id) SELECT span_id, trace_id, depth FROM t")
def span_flatten(spark, sf):
    return X.flatten_spans(_spans(spark, sf)).select("span_id", "trace_id", "depth")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 256")
def event_replay(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(256).select("event_id", "event_type")


@query("SELECT concat('engram_events_', event_type, ' ', CAST(count(*) AS VARCHAR)) AS line FROM events GROUP BY event_type")
def prometheus(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return X.prometheus(c, F.concat(F.lit("events-"), "event_type"), F.col("n"))


@query(
    """SELECT event_id, CASE WHEN (event_id % 10) / 10.0 > 0.6 THEN 'offline' WHEN (event_id % 10) / 10.0 > 0.15 OR value > 320 OR event_id % 120 > 90 THEN 'degraded' WHEN event_id % 7 = 0 THEN 'metered' ELSE 'healthy' END AS state FROM events"""
)
def link_state(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", X.link_state(i % 10 / 10.0, F.col("value"), (i % 120).cast("double"), i % 7 == 0).alias("state"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'offline' WHEN event_id % 3 = 0 THEN 'policy' WHEN value > 180 THEN 'slow_link' WHEN (event_id % 100) / 100.0 >= 0.62 AND event_id % 2 = 0 THEN 'confident' ELSE 'escalate' END AS decision FROM events"""
)
def escalation(spark, sf):
    i = F.col("event_id")
    link = F.when(i % 5 == 0, "offline").otherwise("healthy")
    return table(spark, sf, "events").select("event_id", X.should_escalate(i % 100 / 100.0, link, F.col("value"), i % 3 != 0, i % 2 != 0).alias("decision"))


@query("SELECT event_type AS kind, round(sum(value) / 1000.0, 6) AS joules, count(*) AS ops, round(sum(value) / 1000.0 / count(*), 8) AS per_op, floor(1800.0 / (sum(value) / 1000.0 / count(*))) AS per_percent FROM events GROUP BY event_type")
def energy_account(spark, sf):
    a = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg((F.sum("value") / 1000.0).alias("j"), F.count("*").alias("ops"))
    per = F.col("j") / F.col("ops")
    return a.select("kind", F.round("j", 6).alias("joules"), "ops", F.round(per, 8).alias("per_op"), X.battery_answers(per).cast("double").alias("per_percent"))


@query(
    """, w AS (SELECT point_id % 10 AS tenant, wall_ms // 60000 AS win, count(*) AS writes FROM ops GROUP BY ALL) SELECT tenant, win, writes, writes > 1 AS over, CAST(sum(writes) OVER (PARTITION BY tenant ORDER BY win) AS BIGINT) AS used FROM w"""
)
def tenant_quota(spark, sf):
    from pyspark.sql import Window

    o = ops(spark, sf).select((F.col("point_id") % 10).alias("tenant"), F.expr("wall_ms DIV 60000").alias("win"))
    w = o.groupBy("tenant", "win").agg(F.count("*").alias("writes"))
    return w.select("tenant", "win", "writes", (F.col("writes") > 1).alias("over"), F.sum("writes").over(Window.partitionBy("tenant").orderBy("win")).alias("used"))


@query(""", r AS (SELECT device_id, {'tokens': CAST(NULL AS DOUBLE), 'last': CAST(wall_ms / 1000.0 AS DOUBLE), 'amount': CAST(1.0 + counter AS DOUBLE), 'ok': CAST(0 AS BIGINT)} AS x, wall_ms, op_id FROM ops),
l AS (SELECT device_id, count(*) AS n, list(x ORDER BY wall_ms, op_id) AS xs FROM r GROUP BY device_id),
f AS (SELECT device_id, n, list_reduce(list_prepend({'tokens': CAST(5.0 AS DOUBLE), 'last': CAST(NULL AS DOUBLE), 'amount': CAST(0 AS DOUBLE), 'ok': CAST(0 AS BIGINT)}, xs), lambda a, x: {'tokens': least(5.0, a.tokens + CASE WHEN a.last IS NULL THEN 0 ELSE greatest(0, x.last - a.last) * CAST(0.001 AS DOUBLE) END) - CASE WHEN least(5.0, a.tokens + CASE WHEN a.last IS NULL THEN 0 ELSE greatest(0, x.last - a.last) * CAST(0.001 AS DOUBLE) END) - x.amount >= 0 THEN x.amount ELSE 0 END, 'last': greatest(coalesce(a.last, x.last), x.last), 'amount': x.amount, 'ok': a.ok + CASE WHEN least(5.0, a.tokens + CASE WHEN a.last IS NULL THEN 0 ELSE greatest(0, x.last - a.last) * CAST(0.001 AS DOUBLE) END) - x.amount >= 0 THEN 1 ELSE 0 END}) AS z FROM l)
SELECT device_id, z.ok AS admitted, n FROM f""")
def token_bucket(spark, sf):
    e = ops(spark, sf).select("device_id", "op_id", (F.col("wall_ms") / 1000.0).alias("t"), (1.0 + F.col("counter")).cast("double").alias("amount"))
    return folds.adaptive_token_bucket(e, "device_id", "t", "amount", 0.001, 5.0, tie="op_id").groupBy("device_id").agg(F.count_if("admitted").alias("admitted"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, (SELECT count(*) FROM events) AS total FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def metrics_snapshot(spark, sf):
    e = table(spark, sf, "events")
    total = e.count()
    return e.where(F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).withColumn("total", F.lit(total).cast("long"))


@query(
    """WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents), u AS (SELECT tok, count(*) AS n FROM (SELECT unnest(k) AS tok FROM t) GROUP BY tok), s AS (SELECT sum(n) AS total, median(n) AS med FROM u)
SELECT tok, n, round(1e-4 / (1e-4 + n / total), 8) AS weight FROM u, s ORDER BY n DESC, tok LIMIT 50"""
)
def token_lexicon(spark, sf):
    from ..functions.text import tokenize

    u = table(spark, sf, "documents").select(F.explode(tokenize(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    total = u.agg(F.sum("n")).first()[0] or 1
    return u.orderBy(F.desc("n"), "tok").limit(50).select("tok", "n", F.round(F.lit(1e-4) / (F.lit(1e-4) + F.col("n") / total), 8).alias("weight"))
