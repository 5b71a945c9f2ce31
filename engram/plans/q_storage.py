"""Scans, logs, segments, queues and payload shaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clocks
from ..operators import storage as S
from ..sources import wal
from .registry import query
from .views import NOW, ops, points, table

_H = "{{'wall_ms': {0}wall_ms, 'counter': {0}counter, 'node': {0}device_id}}"


@query("SELECT point_id, op_id, round(value, 4) AS value FROM ops WHERE kind = 'upsert' QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY op_id DESC) = 1")
def upsert_latest(spark, sf):
    return S.latest(ops(spark, sf).where("kind = 'upsert'").select("point_id", "op_id", "value"), "point_id", [F.col("op_id")]).select("point_id", "op_id", F.round("value", 4).alias("value"))


@query("SELECT id, collection FROM points WHERE id NOT IN (SELECT point_id FROM ops WHERE kind = 'delete')")
def tombstones(spark, sf):
    dead = ops(spark, sf).where("kind = 'delete'").select(F.col("point_id").alias("id"))
    return S.apply_tombstones(points(spark, sf).select("id", "collection"), dead, "id")


@query("SELECT point_id, op_id AS lsn, kind AS op FROM ops QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY op_id DESC) = 1 AND kind <> 'delete'")
def wal_recover(spark, sf):
    return S.recover(ops(spark, sf).select("point_id", F.col("op_id").alias("lsn"), F.col("kind").alias("op")))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE op_id % 97 <> 0) AS applied, count(*) FILTER (WHERE op_id % 97 = 0) AS torn, CAST(sum(op_id) FILTER (WHERE op_id % 97 <> 0) AS BIGINT) AS lsn_sum FROM ops")
def wal_replay(spark, sf):
    record = F.to_json(F.struct(F.col("op_id").alias("lsn"), "kind", "point_id"))
    line = S.wal_line(record)
    lines = ops(spark, sf).select(F.when(F.col("op_id") % 97 == 0, F.concat(F.lit("0"), F.expr("substring(v, 2)"))).otherwise(F.col("v")).alias("value") if False else F.when(F.col("op_id") % 97 == 0, F.regexp_replace(line, "\\}$", "]")).otherwise(line).alias("value"))
    p = S.wal_parse(lines, "lsn long, kind string, point_id long")
    return p.agg(F.count("*").alias("lines"), F.count_if("ok").alias("applied"), F.count_if(~F.col("ok")).alias("torn"), F.sum("record.lsn").alias("lsn_sum"))


_LOG = "op_id long, point_id long, kind string, wall_ms long, body string"


def _log(spark, sf) -> str:
    """A new folder of the shared one with all operations as a log."""
    path = f"{S.shared_folder(spark)}/engram/log-{uuid.uuid4().hex}"
    wal.write(ops(spark, sf).select("op_id", "point_id", "kind", "wall_ms", "body"), f"{path}/log")
    return path


@query("SELECT op_id, point_id, kind, wall_ms, body FROM ops")
def wal_roundtrip(spark, sf):
    return wal.read(spark, f"{_log(spark, sf)}/log", _LOG)


@query("SELECT point_id, op_id, wall_ms FROM ops QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY op_id DESC) = 1 AND kind <> 'delete'")
def wal_stream_recover(spark, sf):
    # the log is followed by a stream into a second one, and what is there at the end is recovered
    path = _log(spark, sf)
    copied = wal.copy(spark, f"{path}/log", f"{path}/copy", f"{path}/offsets", _LOG)
    found = S.recover(copied.select("point_id", F.col("op_id").alias("lsn"), F.col("kind").alias("op"), "wall_ms"))
    return found.select("point_id", F.col("lsn").alias("op_id"), "wall_ms")


_SEG = "seg AS (SELECT op_id AS lsn, op_id // 1000 AS generation, point_id FROM ops)"


def _segments(spark, sf):
    return ops(spark, sf).select(F.col("op_id").alias("lsn"), F.expr("op_id DIV 1000").alias("generation"), "point_id")


@query(f", {_SEG} SELECT generation, count(*) AS records, min(lsn) AS min_lsn, max(lsn) AS max_lsn FROM seg JOIN (SELECT 1 FROM ops LIMIT 1) ON TRUE GROUP BY generation")
def segment_generations(spark, sf):
    return S.generations(_segments(spark, sf))


@query(f", {_SEG} SELECT lsn, generation FROM seg, (SELECT 1 FROM ops LIMIT 1) WHERE generation <= 2")
def segment_read_up_to(spark, sf):
    return S.up_to(_segments(spark, sf), 2).select("lsn", "generation")


@query(f", {_SEG} SELECT max(lsn) AS restored_to, count(*) AS records FROM seg, (SELECT 1 FROM ops LIMIT 1) WHERE generation <= 3")
def restore_to_generation(spark, sf):
    return S.up_to(_segments(spark, sf), 3).agg(F.max("lsn").alias("restored_to"), F.count("*").alias("records"))


@query(f", {_SEG} SELECT generation, count(*) AS records, max(lsn) AS watermark FROM seg, (SELECT 1 FROM ops LIMIT 1) WHERE lsn > 4500 GROUP BY generation")
def incremental_archive(spark, sf):
    new = _segments(spark, sf).where("lsn > 4500")
    return new.groupBy("generation").agg(F.count("*").alias("records"), F.max("lsn").alias("watermark"))


@query("SELECT CAST(max(op_id) AS BIGINT) AS durable, CAST(least(max(op_id), 4500) AS BIGINT) AS rewound FROM ops")
def wal_checkpoint(spark, sf):
    return ops(spark, sf).agg(F.max("op_id").alias("durable"), F.least(F.max("op_id"), F.lit(4500)).cast("long").alias("rewound"))


_FSCK = f"""{_SEG}, man AS (SELECT generation, count(*) AS records FROM seg GROUP BY generation), fil AS (SELECT generation, generation % 5 = 4 AS bad FROM man WHERE generation % 7 <> 3 UNION ALL SELECT generation + 1000, FALSE FROM man WHERE generation % 4 = 0),
st AS (SELECT coalesce(m.generation, f.generation) AS generation, records, CASE WHEN m.generation IS NULL THEN 'orphan' WHEN f.generation IS NULL THEN 'missing' WHEN bad THEN 'corrupt' ELSE 'ok' END AS status FROM man m FULL OUTER JOIN fil f ON m.generation = f.generation)"""


def _fsck(spark, sf):
    man = _segments(spark, sf).groupBy("generation").agg(F.count("*").alias("records")).withColumn("digest", F.sha2(F.col("generation").cast("string"), 256))
    good = man.select("generation", F.when(F.col("generation") % 5 == 4, F.lit("x")).otherwise(F.col("digest")).alias("digest")).where("generation % 7 <> 3")
    return S.fsck(man, good.unionByName(_strays(man)))


def _strays(man):
    """Whole files a thousand generations on; where the manifest knows that generation too, they are its own."""
    later = man.where("generation % 4 = 0").select((F.col("generation") + 1000).alias("generation"))
    return later.withColumn("digest", F.sha2(F.col("generation").cast("string"), 256))


@query(f", {_FSCK} SELECT generation, status FROM st, (SELECT 1 FROM ops LIMIT 1)")
def segments_fsck(spark, sf):
    return _fsck(spark, sf).select("generation", "status")


@query(f", {_FSCK} SELECT status, count(*) AS files, CAST(sum(coalesce(records, 0)) AS BIGINT) AS records FROM st, (SELECT 1 FROM ops LIMIT 1) WHERE status IN ('corrupt', 'missing') GROUP BY status")
def lost_records(spark, sf):
    return _fsck(spark, sf).where("status in ('corrupt', 'missing')").groupBy("status").agg(F.count("*").alias("files"), F.sum(F.coalesce("records", F.lit(0))).alias("records"))


@query(f", {_FSCK}, bad AS (SELECT generation FROM st WHERE status IN ('corrupt', 'missing')) SELECT p.id, CASE WHEN p.id % 3 = 0 THEN 'resident' ELSE 'lost' END AS fate FROM points p WHERE p.id // 100 IN (SELECT generation FROM bad) AND (SELECT count(*) FROM ops) > 0")
def repair_assess(spark, sf):
    bad = _fsck(spark, sf).where("status in ('corrupt', 'missing')").select("generation")
    hit = points(spark, sf).select("id", F.expr("id DIV 100").alias("generation")).join(bad, "generation", "left_semi")
    resident = hit.where("id % 3 = 0").select("id")
    lost = hit.join(resident, "id", "left_anti").select("id", F.lit("lost").alias("fate"))
    return lost.union(hit.join(resident, "id", "left_semi").select("id", F.lit("resident").alias("fate")))


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings WHERE vec_id IN (SELECT n_nationkey * 7 FROM nation)")
def gather_vectors(spark, sf):
    ids = table(spark, sf, "nation").select((F.col("n_nationkey") * 7).cast("long").alias("vec_id"))
    v = table(spark, sf, "embeddings").join(ids, "vec_id", "left_semi")
    return v.select("vec_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT id, lang FROM points ORDER BY id LIMIT 50")
def scroll_sample(spark, sf):
    return points(spark, sf).select("id", "lang").orderBy("id").limit(50)


@query("SELECT op_id, kind, (SELECT greatest(0, count(*) - 100) FROM ops WHERE op_id > 700) AS remaining FROM ops WHERE op_id > 700 ORDER BY op_id LIMIT 100")
def pull_page(spark, sf):
    return S.page(ops(spark, sf).select("op_id", "kind"), "op_id", 700, 100)


@query(
    f""", st AS (SELECT point_id, max({_H.format('')}) AS h FROM ops WHERE op_id % 2 = 0 GROUP BY point_id)
SELECT o.op_id, st.h IS NULL OR {_H.format('o.')} > st.h AS accepted FROM ops o LEFT JOIN st ON st.point_id = o.point_id WHERE o.op_id % 2 = 1"""
)
def push_lww(spark, sf):
    o = ops(spark, sf)
    heads = S.latest(o.where("op_id % 2 = 0").select("point_id", "wall_ms", "counter", "device_id"), "point_id", [F.col("wall_ms"), F.col("counter"), F.col("device_id")])
    return S.push_lww(heads, o.where("op_id % 2 = 1")).select("op_id", "accepted")


@query("SELECT op_id, point_id FROM ops WHERE op_id % 3 <> 0")
def queue_pending(spark, sf):
    o = ops(spark, sf).select("op_id", "point_id")
    return S.pending(o.union(o.where("op_id % 5 = 0")), o.where("op_id % 3 = 0"))


@query("SELECT CAST(count(DISTINCT op_id) AS BIGINT) AS kept, CAST(count(*) - count(DISTINCT op_id) AS BIGINT) AS duplicates FROM (SELECT op_id FROM ops UNION ALL SELECT op_id FROM ops WHERE op_id % 4 = 0)")
def dedup_ops(spark, sf):
    o = ops(spark, sf).select("op_id")
    both = o.union(o.where("op_id % 4 = 0"))
    return both.groupBy("op_id").agg(F.count("*").alias("c")).agg(F.count("*").alias("kept"), F.sum(F.col("c") - 1).alias("duplicates"))


_EL = "f AS (SELECT op_id, op_id // 64 AS frame, device_id, kind, point_id FROM ops)"


@query(
    f""", {_EL}, l AS (SELECT *, row_number() OVER w > 1 AND device_id = lag(device_id) OVER w AS d, row_number() OVER w > 1 AND kind = lag(kind) OVER w AS k FROM f, (SELECT 1 FROM ops LIMIT 1) WINDOW w AS (PARTITION BY frame ORDER BY op_id))
SELECT frame, count(*) AS n, count(*) FILTER (WHERE coalesce(d, FALSE)) AS same_device, count(*) FILTER (WHERE coalesce(k, FALSE)) AS same_kind FROM l GROUP BY frame"""
)
def wire_elision(spark, sf):
    o = ops(spark, sf).select("op_id", F.expr("op_id DIV 64").alias("frame"), "device_id", "kind")
    e = S.elide(o, "frame", "op_id", ["device_id", "kind"])
    return e.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("device_id_same").alias("same_device"), F.count_if("kind_same").alias("same_kind"))


@query("SELECT op_id, device_id, kind FROM ops")
def wire_roundtrip(spark, sf):
    o = ops(spark, sf).select("op_id", F.expr("op_id DIV 64").alias("frame"), "device_id", "kind")
    e = S.elide(o, "frame", "op_id", ["device_id", "kind"])
    return S.restore(e, "frame", "op_id", ["device_id", "kind"]).select("op_id", "device_id", "kind")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 = 0 OR doc_id % 13 = 0 UNION ALL SELECT concat('new', CAST(doc_id AS VARCHAR)), 'added' FROM documents WHERE doc_id % 100 = 1")
def digest_diff(spark, sf):
    d = table(spark, sf, "documents")
    path = F.col("doc_id").cast("string")
    a = d.select(path.alias("path"), F.md5("text").alias("digest"))
    b = d.where("doc_id % 10 <> 0").select(path.alias("path"), F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.md5("text")).alias("digest"))
    b = b.union(d.where("doc_id % 100 = 1").select(F.concat(F.lit("new"), path), F.md5("text")))
    return S.digest_diff(a, b)


# ------------------------------------------------------------ payload shaping


@query("SELECT id, collection, tenant_id, sensitivity, access_count, CASE WHEN id % 9 = 0 THEN 'override' ELSE source END AS source, len(text) AS n_text FROM points")
def payload_projection(spark, sf):
    p = points(spark, sf)
    base = F.map_from_arrays(F.array(*[F.lit(k) for k in ("collection", "tenant_id", "sensitivity", "access_count", "source")]), F.array("collection", "tenant_id", "sensitivity", F.col("access_count").cast("string"), "source"))
    own = F.when(F.col("id") % 9 == 0, F.map_from_arrays(F.array(F.lit("source")), F.array(F.lit("override")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_zip_with(base, own, lambda k, a, b: F.coalesce(b, a))
    m = p.select("id", merged.alias("m"), F.length("text").cast("long").alias("n_text"))
    return m.select("id", *[F.col("m")[k].alias(k) for k in ("collection", "tenant_id", "sensitivity")], F.col("m")["access_count"].cast("int").alias("access_count"), F.col("m")["source"].alias("source"), "n_text")


@query("SELECT id, collection, source, confidence, CASE WHEN dense IS NULL THEN 0 ELSE len(list_filter(CAST(dense AS DOUBLE[]), lambda x: x > 0.1)) END AS sparse_terms FROM points")
def summary(spark, sf):
    p = points(spark, sf).withColumn("sparse_terms", F.coalesce(F.size(F.filter("dense", lambda x: x.cast("double") > 0.1)), F.lit(0)))
    return p.withColumn("sparse_terms", F.when(F.col("dense").isNull(), 0).otherwise(F.col("sparse_terms"))).select("id", "collection", "source", "confidence", F.col("sparse_terms").cast("long").alias("sparse_terms"))


@query("SELECT id, count(*) AS reads, max(wall_ms) AS last_read_ms FROM points JOIN ops ON ops.point_id = points.id GROUP BY id")
def access_touch(spark, sf):
    log = ops(spark, sf).select(F.col("point_id").alias("id"), "wall_ms")
    return points(spark, sf).select("id").join(log, "id").groupBy("id").agg(F.count("*").alias("reads"), F.max("wall_ms").alias("last_read_ms"))


@query(
    """, a AS (SELECT id, dense[1] AS x, dense[2] AS y FROM points WHERE dense IS NOT NULL), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM a)
SELECT id, round(CAST(CAST(x AS DOUBLE) - lx AS DOUBLE) / CASE WHEN hx = lx THEN 1 ELSE CAST(hx AS DOUBLE) - lx END, 5) AS x, round((CAST(y AS DOUBLE) - ly) / CASE WHEN hy = ly THEN 1 ELSE CAST(hy AS DOUBLE) - ly END, 5) AS y FROM a, b"""
)
def scale_coordinates(spark, sf):
    p = points(spark, sf).where("dense is not null").select("id", *[F.element_at("dense", i + 1).cast("double").alias(c) for i, c in enumerate("xy")])
    b = p.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return p.select("id", *[F.round((F.col(c) - b[f"lo{c}"]) / ((b[f"hi{c}"] - b[f"lo{c}"]) or 1.0), 5).alias(c) for c in "xy"])


@query("SELECT op_id, concat(lpad(CAST(wall_ms AS VARCHAR), 13, '0'), '.', lpad(CAST(counter AS VARCHAR), 5, '0'), '.', device_id) AS packed, wall_ms, counter, device_id AS node FROM ops")
def hlc_pack_parse(spark, sf):
    o = ops(spark, sf).select("op_id", clocks.pack(F.col("wall_ms"), F.col("counter"), F.col("device_id")).alias("packed"))
    return o.withColumn("h", clocks.parse(F.col("packed"))).select("op_id", "packed", "h.wall_ms", "h.counter", "h.node")


@query("SELECT id, tier, CASE WHEN tier = 'cold' THEN 'codes' ELSE 'vector' END AS stored FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'hot' WHEN id % 4 = 1 THEN 'warm' ELSE 'cold' END AS tier FROM points)")
def move_tier(spark, sf):
    tier = F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 4 == 1, "warm").otherwise("cold")
    return points(spark, sf).select("id", tier.alias("tier")).withColumn("stored", F.when(F.col("tier") == "cold", "codes").otherwise("vector"))


@query("SELECT id FROM points WHERE superseded_by IS NULL ORDER BY created_at DESC, id LIMIT 40")
def list_newest(spark, sf):
    return points(spark, sf).where("superseded_by is null").orderBy(F.desc("created_at"), "id").limit(40).select("id")


@query(f"SELECT id FROM points WHERE {NOW} - last_access_at > 86400 * 20 AND stale AND superseded_by IS NULL AND source IS NOT NULL ORDER BY id LIMIT 8")
def revalidate_sources(spark, sf):
    p = points(spark, sf).where((F.lit(NOW) - F.col("last_access_at") > 86400 * 20) & F.col("stale") & F.col("superseded_by").isNull() & F.col("source").isNotNull())
    return p.orderBy("id").limit(8).select("id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'v1' ELSE 'v2' END AS model_version FROM points WHERE id % 3 = 0 ORDER BY pinned DESC, access_count DESC, id LIMIT 64")
def migrate_batch(spark, sf):
    p = points(spark, sf).withColumn("model_version", F.when(F.col("id") % 3 == 0, "v1").otherwise("v2"))
    return p.where("model_version <> 'v2'").orderBy(F.desc("pinned"), F.desc("access_count"), "id").limit(64).select("id", "model_version")
