"""Sync rounds, convergence, damage and repair, filter keys, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, learning, quantize, sync
from ..operators import storage as S
from .q_storage import _FSCK, _SEG, _segments, _strays
from .registry import query
from .views import ops, table


@query("SELECT CAST(count(*) FILTER (WHERE op_id % 7 <> 0 AND op_id % 11 = 0) AS BIGINT) AS pushed, CAST(count(*) FILTER (WHERE op_id % 7 = 0 AND op_id % 11 <> 0) AS BIGINT) AS pulled, CAST(0 AS BIGINT) AS differing_after FROM ops")
def sync_round(spark, sf):
    o = ops(spark, sf).select("op_id")
    r = sync.reconcile(o.where("op_id % 7 <> 0"), o.where("op_id % 11 <> 0"))
    after = sync.reconcile(r["local"], r["remote"])["buckets"].agg(F.count("*").alias("differing_after"))
    return r["push"].agg(F.count("*").alias("pushed")).join(r["pull"].agg(F.count("*").alias("pulled"))).join(after)


@query("SELECT op_id, CAST(CAST(op_id % 2 = 0 AS INT) + CAST(op_id % 3 <> 1 AS INT) + CAST(op_id % 5 <> 2 AS INT) AS BIGINT) AS holders FROM ops WHERE holders BETWEEN 1 AND 2")
def converged_peers(spark, sf):
    o = ops(spark, sf).select("op_id")
    return sync.unconverged({"a": o.where("op_id % 2 = 0"), "b": o.where("op_id % 3 <> 1"), "c": o.where("op_id % 5 <> 2")})


_BAD = f", {_FSCK}, bad AS (SELECT generation FROM st WHERE status IN ('corrupt', 'missing')), lost AS (SELECT lsn FROM seg WHERE generation IN (SELECT generation FROM bad))"


def _damaged(spark, sf):
    man = _segments(spark, sf).groupBy("generation").agg(F.count("*").alias("records")).withColumn("digest", F.sha2(F.col("generation").cast("string"), 256))
    good = man.select("generation", F.when(F.col("generation") % 5 == 4, F.lit("x")).otherwise(F.col("digest")).alias("digest")).where("generation % 7 <> 3")
    return man, good.unionByName(_strays(man))


@query(f"{_BAD} SELECT CAST(least(max(op_id), coalesce((SELECT min(lsn) FROM lost) - 1, max(op_id))) AS BIGINT) AS watermark FROM ops")
def rewind_archive(spark, sf):
    s = _segments(spark, sf)
    bad = S.fsck(*_damaged(spark, sf)).where("status in ('corrupt', 'missing')").select("generation")
    top = s.agg(F.max("lsn")).first()[0]
    return spark.createDataFrame([(sync.rewound(top, s.join(bad, "generation", "left_semi")),)], "watermark long")


@query(f"{_BAD} SELECT lsn AS op_id, CASE WHEN lsn % 3 <> 0 THEN 'peer' WHEN lsn % 5 <> 0 THEN 'cloud' ELSE 'gone' END AS source FROM lost WHERE (SELECT count(*) FROM ops) > 0")
def repair_lost(spark, sf):
    s = _segments(spark, sf)
    bad = S.fsck(*_damaged(spark, sf)).where("status in ('corrupt', 'missing')").select("generation")
    lost = s.join(bad, "generation", "left_semi").select(F.col("lsn").alias("op_id"))
    o = ops(spark, sf).select("op_id")
    return sync.repair(lost, o.where("op_id % 3 <> 0"), o.where("op_id % 5 <> 0"))


@query(
    f"""{_BAD} SELECT CAST((SELECT count(*) FROM st WHERE status = 'corrupt') AS BIGINT) AS corrupt, CAST((SELECT count(*) FROM st WHERE status = 'missing') AS BIGINT) AS missing, CAST(coalesce(min(lsn) - 1, (SELECT max(op_id) FROM ops)) AS BIGINT) AS watermark,
count(*) FILTER (WHERE lsn % 3 <> 0) AS peer, count(*) FILTER (WHERE lsn % 3 = 0 AND lsn % 5 <> 0) AS cloud, count(*) FILTER (WHERE lsn % 15 = 0) AS gone FROM lost"""
)
def scrub_archive(spark, sf):
    s = _segments(spark, sf)
    held = s.select("lsn")
    r = sync.scrub(*_damaged(spark, sf), s, held.where("lsn % 3 <> 0"), held.where("lsn % 5 <> 0"), s.agg(F.max("lsn")).first()[0])
    return spark.createDataFrame([tuple(r[k] for k in ("corrupt", "missing", "watermark", "peer", "cloud", "gone"))], "corrupt long, missing long, watermark long, peer long, cloud long, gone long")


@query("SELECT lang, source, count(*) AS n, sha256(concat('{\"lang\":\"', lang, '\",\"source\":\"', source, '\"}')) AS key FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def filter_keys(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return d.withColumn("key", filters.spec_key("source", "lang"))


@query("SELECT doc_id AS id, md5(concat('9|', CAST(doc_id AS VARCHAR))) AS h FROM documents ORDER BY h, id LIMIT 256")
def reservoir(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return learning.reservoir(d, "id", 256, 9)


@query(
    """WITH t AS (SELECT doc_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS k FROM documents WHERE doc_id % 50 = 0)
SELECT query_id, array_to_string(list_filter(k, lambda x, i: CAST(concat('0x', substr(md5(concat('3|', CAST(query_id AS VARCHAR), '|', CAST(i - 1 AS VARCHAR))), 1, 8)) AS BIGINT) < CAST(0.6 * 4294967296 AS BIGINT)), ' ') AS probe FROM t WHERE len(k) >= 4"""
)
def probe_set(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return learning.probes(d, "query_id", keep=0.6, seed=3)


@query("SELECT tenant AS tenant_id, concat(tenant, '::', n_name) AS namespace FROM (SELECT concat('T', CAST(n_regionkey AS VARCHAR)) AS tenant, n_name FROM nation)")
def tenant_namespace(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("tenant_id"), "n_name")
    return n.select("tenant_id", filters.namespace(F.col("tenant_id"), F.col("n_name")).alias("namespace"))


@query("SELECT op_id, CASE WHEN op_id < 128 THEN printf('%02X', op_id) WHEN op_id < 16384 THEN printf('%02X%02X', (op_id & 127) | 128, op_id >> 7) ELSE printf('%02X%02X%02X', (op_id & 127) | 128, ((op_id >> 7) & 127) | 128, op_id >> 14) END AS code FROM ops")
def varint_codes(spark, sf):
    o = ops(spark, sf).select("op_id")
    return o.select("op_id", F.hex(quantize.varint(F.col("op_id"))).alias("code"))
