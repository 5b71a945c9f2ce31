"""Tiering, freshness, consolidation and statistics of stored points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .storage import written


def tier_salience(now: float, half_life_s: float = 6 * 3600.0) -> Column:
    """Recency times frequency times confidence; infinite for pinned points."""
    idle = F.greatest(F.lit(0.0), F.lit(now) - F.col("last_access_at"))
    s = F.pow(F.lit(0.5), idle / half_life_s) * (1.0 + F.log1p(F.col("access_count").cast("double"))) * F.greatest(F.col("confidence"), F.lit(0.05))
    return F.when(F.col("pinned"), F.lit(float("inf"))).otherwise(s)


def tier_plan(points: DataFrame, now: float, hot: int, warm: int, expired: Column) -> DataFrame:
    """id, tier of every point. The ranking is cut at two places only, so the two boundary
    rows are found as a top-k and compared with, and no task sorts all points."""
    order = [F.desc("salience"), F.asc("id")]
    scored = points.select("id", tier_salience(now).alias("salience"), expired.alias("expired"))
    cuts = []
    for n in (hot, hot + warm):
        last = scored.orderBy(*order).limit(n).agg(F.count("*").alias("n"), F.min_by(F.struct("salience", "id"), F.struct("salience", -F.col("id"))).alias("c")).first()
        cuts.append(last.c if last.n else None)

    def within(cut) -> Column:
        if cut is None:
            return F.lit(False)
        s = F.lit(float(cut["salience"]))
        return (F.col("salience") > s) | ((F.col("salience") == s) & (F.col("id") <= cut["id"]))

    tier = F.when(F.col("expired"), "evicted").when(within(cuts[0]), "hot").when(within(cuts[1]), "warm").otherwise("cold")
    return scored.select("id", tier.alias("tier"))


TIERS = ("hot", "warm", "cold", "evicted")


def compaction_report(current: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: promoted, demoted, evicted, scanned. current: id, tier."""
    def rank(c: str) -> Column:
        return F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col(c))

    both = current.withColumnRenamed("tier", "old").join(plan.withColumnRenamed("tier", "new"), "id")
    evicted = F.col("new") == "evicted"
    return both.agg(
        F.count_if(~evicted & (rank("new") < rank("old"))).alias("promoted"),
        F.count_if(~evicted & (rank("new") > rank("old"))).alias("demoted"),
        F.count_if(evicted & (F.col("old") != "evicted")).alias("evicted"),
        F.count("*").alias("scanned"),
    )


def freshness(now: float, verified: Column, half_life_s: float = 21 * 86400.0) -> Column:
    age = F.greatest(F.lit(0.0), F.lit(now) - verified)
    return F.when(F.col("pinned"), F.lit(1.0)).otherwise(F.round(F.pow(F.lit(0.5), age / half_life_s) * F.greatest(F.col("confidence"), F.lit(0.1)), 6))


def freshness_sweep(points: DataFrame, score: Column, expired: Column, below: float = 0.35) -> DataFrame:
    """points with freshness, stale_now and what happened: marked, revived, expired or kept."""
    out = points.withColumns({"freshness": score, "expired": expired})
    low = F.col("freshness") < below
    change = F.when(F.col("expired"), "expired").when(low & ~F.col("stale"), "marked").when(~low & F.col("stale"), "revived").otherwise("kept")
    return out.withColumns({"change": change, "stale_now": F.when(F.col("expired"), F.col("stale")).otherwise(low)})


def stats(points: DataFrame, keys: list[str]) -> DataFrame:
    """key, value, n for the values of several columns in one pass."""
    sets = points.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, k in enumerate(keys):
        own = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        which = F.when(F.col("_g") == own, k).otherwise(which)
        value = F.when(F.col("_g") == own, F.col(k).cast("string")).otherwise(value)
    return sets.select(which.alias("key"), value.alias("value"), "n")


def zero_filled(counts: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    return domain.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cardinality(points: DataFrame, fields: list[str]) -> DataFrame:
    """field, distinct values."""
    one = points.agg(*[F.count_distinct(f).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select("x.*")


def centroid(vectors: DataFrame, by: str, vec: str = "dense") -> DataFrame:
    """by, centroid: means by dimension, combined before the shuffle."""
    at = vectors.where(F.col(vec).isNotNull()).select(by, F.posexplode(V.doubles(F.col(vec))).alias("p", "x"))
    per = at.groupBy(by, "p").agg(F.avg("x").alias("x"))
    return per.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("centroid"))


def medoid(vectors: DataFrame, by: str, vec: str = "dense", key: str = "id") -> DataFrame:
    """by, id, n: the member nearest to its cluster's centroid, the smallest id among equals."""
    c = centroid(vectors, by, vec)
    scored = vectors.where(F.col(vec).isNotNull()).join(c, by).select(by, F.col(key).alias("id"), F.round(V.dot(F.col(vec), F.col("centroid")), 9).alias("d"))
    return scored.groupBy(by).agg(F.max_by("id", F.struct("d", -F.col("id"))).alias("id"), F.count("*").alias("n"))


#: Rows of one side of a task that compares all pairs.
GROUP = 4096


def similar_pairs(vectors: DataFrame, threshold: float, block: str, vec: str = "dense", key: str = "id") -> DataFrame:
    """a < b, score of vectors at or above the threshold that share a block. All pairs of a block are
    looked at, which is quadratic: its rows are dealt to groups, each pair of groups is one task's
    product of two matrices, a part at a time, and only pairs that pass are put out."""
    rows = vectors.where(F.col(block).isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull()), F.lit(False)))
    rows = rows.select(F.col(block).alias("_b"), F.size(vec).alias("_n"), F.col(key).alias("id"), F.col(vec).alias("v"))
    most = rows.groupBy("_b", "_n").count().agg(F.max("count")).first()[0] or 1
    groups = -(-most // GROUP)
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = rows.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).select("*", other.alias("_o"))
    dealt = dealt.withColumns({"_x": F.least("_g", "_o"), "_y": F.greatest("_g", "_o")})
    kind = dict(rows.dtypes)["id"]

    def pairs(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        g, x, y = (table.column(c).to_numpy() for c in ("_g", "_x", "_y"))
        a, b = np.flatnonzero(g == x), np.flatnonzero(g == y)
        left, right, scores = [], [], []
        for lo in range(0, len(a), 256):
            p = a[lo : lo + 256]
            near = ~(v[p] @ v[b].T < threshold - 1e-9)  # not a number counts as near, as in Spark
            i, j = np.nonzero(near)
            i, j = p[i], b[j]
            i, j = (i[i < j], j[i < j]) if x[0] == y[0] else (i, j)
            s = np.zeros(len(i))
            for d in range(v.shape[1]):  # from left to right, as dot() adds up
                s += v[i, d] * v[j, d]
            kept = ~(s < threshold)
            left.append(i[kept]), right.append(j[kept]), scores.append(s[kept])
        i, j, s = (np.concatenate(z) if z else np.zeros(0, t) for z, t in ((left, int), (right, int), (scores, float)))
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "score": s})

    found = dealt.groupBy("_b", "_n", "_x", "_y").applyInArrow(pairs, f"a {kind}, b {kind}, score double")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def clusters(pairs: DataFrame, least: int = 3) -> DataFrame:
    """id, cluster (smallest id) of the connected groups of at least some members. Each round takes
    the smallest label among the neighbours and then the label of that label, until nothing
    moves; a round is a written table, so a lost executor costs a re-read."""
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("u", "v").distinct(), "cluster-edges")
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "cluster-labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near, "u").select("u", F.least("l", "m").alias("n"), "l")
        up = label.select(F.col("u").alias("n"), F.col("l").alias("j"))
        moved = written(step.join(up, "n", "left").select("u", F.least("n", F.coalesce("j", "n")).alias("n"), "l"), "cluster-labels")
        label = moved.select("u", F.col("n").alias("l"))
        if moved.where("n <> l").isEmpty():
            break
    big = label.groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return label.join(big, "l").select(F.col("u").alias("id"), F.col("l").alias("cluster"))
