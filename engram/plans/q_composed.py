"""Composed plans and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds
from ..operators import retrieval as R
from . import search as S
from .q_retrieval import index_table
from .registry import query
from .views import NOW, ops, points, table


def _asked(spark, sf):
    p = points(spark, sf)
    index = index_table(spark, sf)
    q = p.where("dense is not null and id % 50 = 0").select(F.col("id").alias("query_id"), "text", F.col("dense").alias("q"))
    return p, index, q


@query()
def search_pipeline(spark, sf):
    p, index, q = _asked(spark, sf)
    m = p.where("id % 3 = 0").select((F.col("id") - F.col("id") % 50).alias("query_id"), "id", (F.col("id") % 7).alias("mentions"))
    return S.search(p, index, q, NOW, k=5, spec={"sensitivity": ["public", "internal", "sensitive"]}, mentions=m).select("query_id", "id", F.round("score", 4).alias("score"), "rank", "contributors", "in_set")


@query()
def search_shed(spark, sf):
    p, index, q = _asked(spark, sf)
    return S.search(p, index, q, NOW, k=5, level=4).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query()
def search_relaxed(spark, sf):
    p, index, q = _asked(spark, sf)
    return S.search_relaxed(p, index, q, NOW, inferred={"collection": "nowhere"}, asked={"lang": "en"}, k=3).select("query_id", "id", "rank", "relaxed")


@query()
def ask_answer(spark, sf):
    p, index, q = _asked(spark, sf)
    return S.answer(p, S.search(p, index, q, NOW, k=5)).select("query_id", "citations", "contradicted", F.round("confidence", 4).alias("confidence"))


@query("SELECT tenant_id, count(*) AS n FROM (SELECT id, tenant_id FROM points WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) <= 40) GROUP BY tenant_id")
def ingest_quota(spark, sf):
    p = points(spark, sf)
    rows = p.select("id", "text", "collection", "source", "tenant_id", "confidence", F.col("created_at").alias("ts"))
    done = S.ingest(rows.union(rows.where("id % 5 = 0")), p.where("id % 2 = 0").select("id", F.lit("other").alias("tenant_id")), quota=40)
    return done["points"].groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents), u AS (SELECT tok, count(*) AS n FROM (SELECT unnest(k) AS tok FROM t) GROUP BY tok) SELECT round(greatest(1e-6, least(1e-2, median(n) / sum(n))), 10) AS a FROM u")
def lexicon_calibrate(spark, sf):
    from ..functions.text import tokenize

    u = table(spark, sf, "documents").select(F.explode(tokenize(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    return u.agg(F.round(F.greatest(F.lit(1e-6), F.least(F.lit(1e-2), F.median("n") / F.sum("n"))), 10).alias("a"))


@query("""WITH r AS (SELECT event_type, event_id, {'rtt': CAST(value AS DOUBLE), 'jitter': CAST(0 AS DOUBLE), 'loss': CAST(0 AS DOUBLE), 'good': CASE WHEN event_id % 13 <> 0 THEN 1 ELSE 0 END} AS x FROM events), l AS (SELECT event_type, list(x ORDER BY event_id) AS xs FROM r GROUP BY event_type),
f AS (SELECT event_type, list_reduce(list_prepend({'rtt': CAST(0 AS DOUBLE), 'jitter': CAST(0 AS DOUBLE), 'loss': CAST(0 AS DOUBLE), 'good': 0}, xs), lambda a, x: CASE WHEN x.good = 1 THEN {'rtt': CAST(0.3 AS DOUBLE) * x.rtt + CAST(0.7 AS DOUBLE) * CASE WHEN a.rtt = 0 THEN x.rtt ELSE a.rtt END, 'jitter': CAST(0.3 AS DOUBLE) * abs(x.rtt - a.rtt) + CAST(0.7 AS DOUBLE) * a.jitter, 'loss': CASE WHEN a.good + 1 >= 2 THEN least(a.loss * 0.5, CAST(0.05 AS DOUBLE)) ELSE a.loss * 0.5 END, 'good': a.good + 1} ELSE {'rtt': a.rtt, 'jitter': a.jitter, 'loss': CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * a.loss, 'good': 0} END) AS s FROM l)
SELECT event_type, round(s.rtt, 4) AS rtt, round(s.jitter, 4) AS jitter, round(s.loss, 6) AS loss FROM f""")
def link_ewma(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", F.col("value").alias("rtt"), (F.col("event_id") % 13 != 0).alias("ok"))
    return folds.link_health(e, "event_type", "event_id")


@query(""", RECURSIVE r AS (SELECT device_id, wall_ms / 1000.0 AS t, value / 100.0 AS b, row_number() OVER (PARTITION BY device_id ORDER BY wall_ms / 1000.0, value / 100.0) AS n FROM ops),
s AS (SELECT device_id, n, t, t AS since, 0 AS level, FALSE AS moved FROM r WHERE n = 1
 UNION ALL SELECT device_id, n, t, CASE WHEN aim <> level THEN t ELSE since END, aim, aim <> level
 FROM (SELECT s.device_id, r.n, r.t, s.since, s.level, CASE WHEN r.t - s.since < 8 THEN s.level WHEN r.b >= 2 THEN least(4, s.level + 1) WHEN r.b <= 0.5 THEN greatest(0, s.level - 1) ELSE s.level END AS aim FROM s JOIN r ON r.device_id = s.device_id AND r.n = s.n + 1))
SELECT device_id, t, level FROM s WHERE moved""")
def slo_ladder(spark, sf):
    e = ops(spark, sf).select("device_id", (F.col("wall_ms") / 1000.0).alias("t"), (F.col("value") / 100.0).alias("burn"))
    return folds.degradation(e, "device_id", "t", "burn")


@query(""", r AS (SELECT device_id, op_id, {'w': wall_ms, 'c': CAST(counter AS BIGINT)} AS x FROM ops), l AS (SELECT device_id, list(x ORDER BY op_id) AS xs FROM r GROUP BY device_id),
f AS (SELECT device_id, list_reduce(list_prepend({'w': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT)}, xs), lambda a, x: {'w': greatest(a.w, x.w), 'c': CASE WHEN x.w = a.w THEN greatest(a.c, x.c) + 1 WHEN x.w > a.w THEN x.c + 1 ELSE a.c + 1 END}) AS s FROM l)
SELECT device_id, concat(lpad(CAST(s.w AS VARCHAR), 13, '0'), '.', lpad(CAST(s.c AS VARCHAR), 5, '0')) AS last FROM f""")
def hlc_observe(spark, sf):
    return folds.hybrid_clock(ops(spark, sf).select("device_id", "op_id", "wall_ms", "counter"), "device_id", "op_id").groupBy("device_id").agg(F.max("stamp").alias("last"))


@query("SELECT sha256(string_agg(concat(n_name, '=', sha256(n_name)), ',' ORDER BY n_name)) AS root FROM nation")
def provenance_root(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.sha2("n_name", 256).alias("d"))
    one = n.agg(F.array_sort(F.collect_list(F.struct("n_name", "d"))).alias("x"))
    return one.select(F.sha2(F.array_join(F.transform("x", lambda r: F.concat(r["n_name"], F.lit("="), r["d"])), ","), 256).alias("root"))


@query("SELECT vec_id AS id, list_sum(list_transform(range(1, 5), lambda i: CAST(round(embedding[i], 3) AS DOUBLE))) IS NOT NULL AS has_dense, len(embedding) AS dims FROM embeddings")
def named_vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    s = v.select(F.col("vec_id").alias("id"), F.struct(F.col("embedding").cast("array<float>").alias("dense"), F.array().cast("array<float>").alias("lex")).alias("v"))
    return s.select("id", F.col("v.dense").isNotNull().alias("has_dense"), F.size("v.dense").cast("long").alias("dims"))


@query("SELECT doc_id AS id, term, tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) <= 5")
def sparse_vectors(spark, sf):
    from ..functions.text import tokenize

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(tokenize(F.col("text"))).alias("term"))
    c = d.groupBy("id", "term").agg(F.count("*").alias("tf"))
    return R.top_k(c.withColumn("score", F.col("tf")), 5, ["id"], tie="term").select("id", "term", "tf")
