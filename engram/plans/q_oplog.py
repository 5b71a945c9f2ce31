"""Operation log, reconciliation and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks as C
from ..operators import folds
from ..operators import oplog as L
from ..operators.storage import written
from .registry import query
from .views import ops, points, table

_H = "{{'w': {0}wall_ms, 'c': {0}counter, 'd': {0}device_id}}"


@query("SELECT point_id, op_id, kind, round(value, 4) AS value FROM ops QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY wall_ms DESC, counter DESC, device_id DESC, op_id) = 1")
def lww_heads(spark, sf):
    return L.heads(ops(spark, sf)).select("point_id", "op_id", "kind", F.round("value", 4).alias("value"))


@query("SELECT point_id, op_id FROM (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY wall_ms DESC, counter DESC, device_id DESC, op_id) = 1) WHERE kind <> 'delete'")
def lww_materialised(spark, sf):
    return L.materialise(ops(spark, sf)).select("point_id", "op_id")


@query(
    f""", r AS (SELECT *, (op_id * 7919) % 100003 AS arrival FROM ops), h AS (SELECT op_id, wall_ms, {_H.format('')} AS me, max({_H.format('')}) OVER (PARTITION BY point_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM r)
SELECT op_id, CASE WHEN head IS NULL OR me > head THEN 'accepted' WHEN abs(wall_ms - head.w) < 60000 THEN 'conflicted' ELSE 'dropped' END AS class FROM h"""
)
def oplog_merge_classes(spark, sf):
    o = ops(spark, sf).withColumn("arrival", F.col("op_id") * 7919 % 100003)
    return L.merge_classes(o, "arrival", 60_000).select("op_id", "class")


_PAIRS = """, p AS (SELECT a.op_id AS op_id, a.point_id, a.wall_ms AS lm, a.counter AS lc, a.device_id AS ln, a.wall_ms + (a.op_id % 5) * 100 AS rm, b.counter AS rc, b.device_id AS rn, CAST(0.6 + 0.1 * (a.op_id % 5) AS DOUBLE) AS trust, CAST((a.op_id % 10) / 10.0 AS DOUBLE) AS sim
 FROM ops a JOIN ops b ON b.op_id = a.op_id + 1)"""


def _pairs(spark, sf):
    o = ops(spark, sf)
    b = o.select((F.col("op_id") - 1).alias("op_id"), F.col("counter").alias("remote_counter"), F.col("device_id").alias("remote_node"))
    a = o.select("op_id", "point_id", F.col("wall_ms").alias("local_ms"), F.col("counter").alias("local_counter"), F.col("device_id").alias("local_node"))
    return a.join(b, "op_id").withColumns({"remote_ms": F.col("local_ms") + F.col("op_id") % 5 * 100, "trust": (0.6 + 0.1 * (F.col("op_id") % 5)).cast("double"), "similarity": (F.col("op_id") % 10 / 10.0).cast("double")})


_LADDER = """CASE WHEN abs(rm - lm) >= 250 THEN 'hlc' WHEN abs(1.0 - trust) >= 0.15 THEN 'trust' WHEN sim >= 0.82 THEN 'semantic' ELSE 'human' END"""


@query(
    _PAIRS
    + f""" SELECT op_id, {_LADDER} AS rung, CASE {_LADDER} WHEN 'hlc' THEN CASE WHEN rm > lm OR (rm = lm AND (rc > lc OR (rc = lc AND rn > ln))) THEN 'remote_wins' ELSE 'local_wins' END WHEN 'trust' THEN CASE WHEN trust > 1.0 THEN 'remote_wins' ELSE 'local_wins' END WHEN 'semantic' THEN 'merged' ELSE 'human_review' END AS resolution FROM p"""
)
def conflict_ladder(spark, sf):
    return L.conflict_ladder(_pairs(spark, sf)).select("op_id", "rung", "resolution")


@query(
    """SELECT device_id, CAST(count(*) AS BIGINT) AS n FROM ops WHERE op_id % 6 = 0 AND kind <> 'delete' GROUP BY device_id"""
)
def shareable_ops(spark, sf):
    o = ops(spark, sf)
    local, learned = o.where("op_id % 2 = 0"), o.where("op_id % 3 = 0")
    both = L.shareable(local, learned, F.col("kind") != "delete").where("op_id % 6 = 0")
    return both.groupBy("device_id").agg(F.count("*").alias("n"))


@query(
    """SELECT point_id, CASE WHEN point_id % 4 = 0 THEN CASE WHEN point_id % 8 = 0 THEN 'remote_wins' ELSE 'local_wins' END ELSE 'human_review' END AS resolution, point_id % 4 = 0 AS reviewed FROM (SELECT DISTINCT point_id FROM ops)"""
)
def conflict_review(spark, sf):
    r = ops(spark, sf).select("point_id").distinct().withColumn("resolution", F.lit("human_review"))
    d = r.where("point_id % 4 = 0").select("point_id", F.when(F.col("point_id") % 8 == 0, "remote").otherwise("local").alias("keep"))
    return L.review(r, d)


@query("SELECT op_id, CASE WHEN op_id % 7 = 0 THEN 'only_b' ELSE 'only_a' END AS side FROM ops WHERE (op_id % 7 = 0) <> (op_id % 11 = 0)")
def log_diff(spark, sf):
    o = ops(spark, sf).select("op_id")
    return L.log_diff(o.where("op_id % 7 <> 0"), o.where("op_id % 11 <> 0"))


@query("SELECT CAST(count(*) FILTER (WHERE (op_id % 7 = 0) AND op_id % 11 <> 0) AS BIGINT) AS only_b, CAST(count(*) FILTER (WHERE op_id % 7 <> 0 AND op_id % 11 = 0) AS BIGINT) AS only_a, TRUE AS complete FROM ops")
def iblt_reconcile(spark, sf):
    o = ops(spark, sf).select("op_id")
    sides = [o.where(f"op_id % {k} <> 0") for k in (7, 11)]
    # as many parts of fixed size as the difference may need: peers tell each other their sizes
    # and how many they have in common is bounded from below by a sample of one key in 64
    share = [x.where(F.pmod(F.xxhash64("op_id"), F.lit(64)) == 0) for x in sides]
    differing = L.log_diff(*share).count() * 64
    parts = max(1, -(-differing // 256))
    a, b = (L.iblt_cells(x, 2048, parts=parts) for x in sides)
    found, complete = L.iblt_peel(L.iblt_subtract(a, b), 2048, lambda df: written(df, "iblt"))
    return found.agg(F.count_if(F.col("sign") < 0).alias("only_b"), F.count_if(F.col("sign") > 0).alias("only_a")).withColumn("complete", F.lit(complete))


@query("SELECT point_id, count(*) AS n, CAST(pow(2, ceil(log2(greatest(32, 4 * count(*))))) AS BIGINT) AS cells FROM ops GROUP BY point_id")
def iblt_size(spark, sf):
    return ops(spark, sf).groupBy("point_id").agg(F.count("*").alias("n")).withColumn("cells", L.iblt_size(F.col("n")))


_B = "CAST(CAST(concat('0x', substr(md5(CAST({0} AS VARCHAR)), 1, 8)) AS BIGINT) % 64 AS INT)"


def _h(i: int, e: str) -> str:
    return f"CAST(concat('0x', substr({e}, {1 + 15 * i}, 15)) AS BIGINT)"


_MK = f"""mk AS (SELECT {_B.format('point_id')} AS bucket, sha256(concat(CAST(point_id AS VARCHAR), ':', CAST(v AS VARCHAR))) AS h FROM (SELECT point_id, max(op_id) AS v FROM ops GROUP BY point_id)),
dg AS (SELECT bucket, count(*) AS n, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {', '.join(f"CAST(bit_xor({_h(i, 'h')}) AS VARCHAR)" for i in range(4))})) AS digest FROM mk GROUP BY bucket)"""


def _items(spark, sf):
    return ops(spark, sf).groupBy(F.col("point_id").alias("id")).agg(F.max("op_id").alias("version"))


@query(f", {_MK} SELECT bucket, n, digest FROM dg, (SELECT 1 FROM ops LIMIT 1)")
def merkle_digest(spark, sf):
    return L.merkle(_items(spark, sf))


@query(f", {_MK} SELECT sha256(string_agg(concat(CAST(bucket AS VARCHAR), '=', digest), ',' ORDER BY bucket)) AS root FROM dg WHERE (SELECT count(*) FROM ops) >= 0")
def merkle_root(spark, sf):
    return L.merkle_root(L.merkle(_items(spark, sf)))


@query(f"SELECT DISTINCT {_B.format('point_id')} AS bucket FROM ops WHERE point_id % 40 = 3")
def merkle_divergent(spark, sf):
    a = _items(spark, sf)
    b = a.withColumn("version", F.when(F.col("id") % 40 == 3, -F.col("version")).otherwise(F.col("version")))
    return L.divergent(L.merkle(a), L.merkle(b))


@query(f", d AS (SELECT DISTINCT {_B.format('point_id')} AS bucket FROM ops WHERE point_id % 40 = 3) SELECT DISTINCT point_id AS id FROM ops WHERE {_B.format('point_id')} IN (SELECT bucket FROM d)")
def divergent_points(spark, sf):
    a = _items(spark, sf)
    b = a.withColumn("version", F.when(F.col("id") % 40 == 3, -F.col("version")).otherwise(F.col("version")))
    return a.withColumn("bucket", L.bucket(F.col("id"), 64)).join(L.divergent(L.merkle(a), L.merkle(b)), "bucket", "left_semi").select("id")


@query(f", d AS (SELECT DISTINCT {_B.format('point_id')} AS bucket FROM ops WHERE point_id % 40 = 3), t AS (SELECT count(DISTINCT point_id) AS total, count(DISTINCT point_id) FILTER (WHERE {_B.format('point_id')} IN (SELECT bucket FROM d)) AS touched FROM ops) SELECT total, touched, CAST((total - touched) * 1800 AS BIGINT) AS saved FROM t")
def merkle_bytes_saved(spark, sf):
    a = _items(spark, sf)
    touched = divergent_points(spark, sf).count()
    return a.agg(F.count("*").alias("total")).withColumns({"touched": F.lit(touched).cast("long"), "saved": (F.col("total") - touched) * 1800})


_VC = ", v AS (SELECT op_id, CAST(op_id % 4 AS INT) AS a1, CAST(op_id % 3 AS INT) AS a2, CAST(op_id % 5 AS INT) AS b1, CAST(op_id % 2 AS INT) AS b2 FROM ops)"


def _vc(spark, sf):
    def m(x, y):
        return F.map_from_arrays(F.array(F.lit("n1"), F.lit("n2")), F.array((F.col("op_id") % x).cast("int"), (F.col("op_id") % y).cast("int")))

    return ops(spark, sf).select("op_id", m(4, 3).alias("a"), m(5, 2).alias("b"))


@query(
    _VC
    + """ SELECT op_id, CASE WHEN (a1 < b1 OR a2 < b2) AND (a1 > b1 OR a2 > b2) THEN 'concurrent' WHEN a1 < b1 OR a2 < b2 THEN 'before' WHEN a1 > b1 OR a2 > b2 THEN 'after' ELSE 'equal' END AS ord, greatest(a1, b1) AS m1, greatest(a2, b2) AS m2, a1 + 1 AS t1, b1 = a1 + 1 AND b2 <= a2 AS deliverable FROM v, (SELECT 1 FROM ops LIMIT 1)"""
)
def vclock_compare(spark, sf):
    v = _vc(spark, sf)
    a, b = F.col("a"), F.col("b")
    merged = C.vclock_merge(a, b)
    return v.select("op_id", C.vclock_compare(a, b).alias("ord"), merged["n1"].alias("m1"), merged["n2"].alias("m2"), C.vclock_tick(a, F.lit("n1"))["n1"].alias("t1"), C.vclock_deliverable(a, b, F.lit("n1")).alias("deliverable"))


@query("SELECT op_id, op_id % 97 = 0 AS twice FROM ops WHERE op_id % 97 = 0")
def no_duplicates(spark, sf):
    o = ops(spark, sf).select("op_id")
    return L.duplicates(o.union(o.where("op_id % 97 = 0"))).select("op_id", (F.col("count") == 2).alias("twice"))


@query("SELECT op_id FROM ops QUALIFY NOT coalesce({'w': wall_ms, 'c': counter} > lag({'w': wall_ms, 'c': counter}) OVER (PARTITION BY device_id ORDER BY op_id * 7919 % 100003, op_id), TRUE)")
def clock_monotonic(spark, sf):
    arrived = ops(spark, sf).withColumn("arrival", F.col("op_id") * 7919 % 100003)
    return L.not_monotonic(arrived, order=["arrival", "op_id"]).select("op_id")


@query("SELECT op_id FROM ops WHERE wall_ms > 1706000000000 + 86400000")
def clock_not_poisoned(spark, sf):
    return L.poisoned(ops(spark, sf), 1_706_000_000_000).select("op_id")


@query("SELECT op_id FROM ops WHERE op_id % 3 = 0 AND op_id % 100 = 0")
def origin_retains(spark, sf):
    o = ops(spark, sf).select("op_id")
    return L.missing(o.where("op_id % 3 = 0"), o.where("op_id % 100 <> 0"))


@query("SELECT op_id FROM ops WHERE device_id NOT IN ('edge-0', 'edge-1', 'edge-2')")
def no_fabrication(spark, sf):
    known = spark.createDataFrame([(f"edge-{i}",) for i in range(3)], "device_id string")
    return L.missing(ops(spark, sf), known, "device_id").select("op_id")


@query("SELECT op_id FROM ops WHERE wall_ms <= 1705000000000 + 3600000 AND kind <> 'delete'")
def gossip_admit(spark, sf):
    return L.admit(ops(spark, sf), 1_705_000_000_000, refused=F.col("kind") == "delete").select("op_id")


@query("SELECT device_id, op_id, row_number() OVER (PARTITION BY device_id ORDER BY op_id) AS stamp FROM ops WHERE kind <> 'delete'")
def note_local(spark, sf):
    from pyspark.sql import Window

    o = ops(spark, sf).where("kind <> 'delete'")
    return o.select("device_id", "op_id", F.row_number().over(Window.partitionBy("device_id").orderBy("op_id")).alias("stamp"))


@query(""", s AS (SELECT device_id, op_id, CASE WHEN kind = 'delete' THEN CAST(-0.05 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END AS d FROM ops),
l AS (SELECT device_id, list(d ORDER BY op_id) AS ds FROM s GROUP BY device_id)
SELECT device_id, round(list_reduce(list_prepend(CAST(0.75 AS DOUBLE), ds), lambda a, d: greatest(0.0, least(1.0, a + d))), 6) AS trust FROM l""")
def device_trust(spark, sf):
    o = ops(spark, sf).select("device_id", "op_id", (F.when(F.col("kind") == "delete", -0.05).otherwise(0.01)).alias("delta"))
    return folds.trust(o, "device_id", "op_id", "delta").withColumn("trust", F.round("trust", 6))


@query(""", a AS (SELECT point_id, op_id, op_id % 997 = 0 AS lost, row_number() OVER w AS n, count(*) FILTER (WHERE op_id % 997 = 0) OVER w AS gone FROM ops WINDOW w AS (PARTITION BY point_id ORDER BY op_id))
SELECT point_id, op_id, FALSE AS again, CASE WHEN gone = 0 THEN CAST(n AS INT) END AS delivered FROM a WHERE NOT lost
UNION ALL SELECT point_id, op_id, TRUE, CAST(NULL AS INT) FROM a WHERE NOT lost AND op_id % 50 = 0""")
def causal_delivery(spark, sf):
    # a device has seen all of a point's operations before its own; arrivals are shuffled, some
    # operations are lost and some arrive again
    from pyspark.sql import Window

    w = Window.partitionBy("point_id").orderBy("op_id")
    devices = [f"edge-{i}" for i in range(5)]
    clock = F.create_map(*[x for d in devices for x in (F.lit(d), F.count_if(F.col("device_id") == d).over(w).cast("int"))])
    o = ops(spark, sf).select("point_id", "op_id", F.col("device_id").alias("sender"), clock.alias("clock"), (F.col("op_id") * 7919 % 100003).alias("arrival"))
    o = o.where("op_id % 997 <> 0").withColumn("again", F.lit(False))
    o = o.union(o.where("op_id % 50 = 0").withColumn("arrival", F.col("arrival") + 200_000).withColumn("again", F.lit(True)))
    return L.causal_release(o, "point_id").select("point_id", "op_id", "again", "delivered")


@query("SELECT p.id, o.op_id, CASE WHEN p.sensitivity = 'sensitive' THEN 'sync_after_redaction' ELSE 'sync_full' END AS sync_class FROM points p JOIN (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY wall_ms DESC, counter DESC, device_id DESC, op_id) = 1) o ON o.point_id = p.id WHERE o.kind <> 'delete'")
def materialise_remote(spark, sf):
    from ..operators import governance as G

    p = points(spark, sf).select("id", F.when(F.col("sensitivity") == "sensitive", "sync_after_redaction").otherwise("sync_full").alias("mine"))
    o = L.materialise(ops(spark, sf)).select(F.col("point_id").alias("id"), "op_id")
    return p.join(o, "id").select("id", "op_id", G.strictest([F.col("mine"), F.lit("sync_full")]).alias("sync_class"))


@query("SELECT event_id AS op_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type, props)) AS digest FROM events")
def operation_digest(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("op_id"), F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"), 256).alias("digest"))
