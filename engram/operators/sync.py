"""Replication as a whole: what two replicas exchange, convergence, repair after damage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .oplog import divergent, log_diff, merkle


def reconcile(local: DataFrame, remote: DataFrame, key: str = "op_id") -> dict[str, DataFrame]:
    """One round between two replicas: buckets whose digests differ, what is pushed and pulled from
    these, and both sides' keys afterwards. Only rows of differing buckets are compared."""
    from .oplog import bucket

    a, b = (x.select(F.col(key).alias("id"), F.col(key).alias("version")) for x in (local, remote))
    differing = divergent(merkle(a), merkle(b))
    x, y = (d.select(key).withColumn("bucket", bucket(F.col(key), 64)).join(F.broadcast(differing), "bucket", "left_semi").select(key) for d in (local, remote))
    sides = log_diff(x, y, key)
    push, pull = (sides.where(F.col("side") == s).select(key) for s in ("only_a", "only_b"))
    return {"buckets": differing, "push": push, "pull": pull, "local": local.select(key).union(pull), "remote": remote.select(key).union(push)}


def unconverged(peers: dict[str, DataFrame], key: str = "op_id") -> DataFrame:
    """key, holders of what some but not all peers hold; empty when they have converged."""
    held = reduce(DataFrame.union, [df.select(key).distinct().withColumn("peer", F.lit(name)) for name, df in peers.items()])
    return held.groupBy(key).agg(F.count("*").alias("holders")).where(F.col("holders") < len(peers))


def rewound(watermark: int, quarantined: DataFrame, lsn: str = "lsn") -> int:
    """The archive's watermark after a quarantine: before the first row that has to come again."""
    first = quarantined.agg(F.min(lsn)).first()[0]
    return watermark if first is None else min(watermark, first - 1)


def repair(lost: DataFrame, peers: DataFrame, cloud: DataFrame, key: str = "op_id") -> DataFrame:
    """key, source of lost rows: from a peer, else from the cloud, else gone."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((peers, "_peer"), (cloud, "_cloud")))
    both = lost.select(key).distinct().join(a, key, "left").join(b, key, "left")
    return both.select(key, F.when(F.col("_peer"), "peer").when(F.col("_cloud"), "cloud").otherwise("gone").alias("source"))


def scrub(manifest: DataFrame, files: DataFrame, rows: DataFrame, peers: DataFrame, cloud: DataFrame, watermark: int, generation: str = "generation", lsn: str = "lsn") -> dict:
    """fsck, quarantine, rewind and repair in one pass; counts, and the repaired rows as a table."""
    status = storage.fsck(manifest, files)
    bad = status.where(F.col("status").isin("corrupt", "missing")).select(generation)
    lost = rows.join(F.broadcast(bad), generation, "left_semi")
    fixed = repair(lost, peers, cloud, lsn)
    count = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
    found = {r.source: r["count"] for r in fixed.groupBy("source").count().collect()}
    return {"corrupt": count.get("corrupt", 0), "missing": count.get("missing", 0), "watermark": rewound(watermark, lost, lsn), **{s: found.get(s, 0) for s in ("peer", "cloud", "gone")}, "rows": fixed}
