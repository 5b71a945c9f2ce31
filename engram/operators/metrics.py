"""Metrics, objectives and traces over tables of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The level from which each optional stage is off.
FEATURES = {
    "triton_escalation": 1,
    "wide_fetch": 1,
    "graph_boost": 1,
    "late_interaction": 2,
    "adapter": 2,
    "query_understanding": 2,
    "cross_encoder": 3,
    "diversity": 3,
    "sparse": 4,
    "background_maintenance": 4,
}


def allows(feature: str, level: int) -> bool:
    return feature not in FEATURES or level < FEATURES[feature]


def allowed_at(level: Column) -> Column:
    """array<struct<feature, allowed>> of all features at a level."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), (level < top).alias("allowed")) for f, top in FEATURES.items()])


def ordered_at(values: Column, index: Column) -> Column:
    """The value at a 0-based place of the sorted values of a bounded group."""
    return F.element_at(F.array_sort(values), index.cast("int") + 1)


def quantile_rank(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Exact order statistics of large groups, without collecting them: distinct values are
    counted first, and the running count tells where a place falls. places: 0-based, in terms
    of n, the size of the group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    run = counted.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(*by))})
    picks = [F.max(F.when((F.col("upto") > p) & (F.col("upto") - F.col("c") <= p), F.col(value))).alias(k) for k, p in places.items()]
    return run.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, p50, p95 and p99 (place floor(q * n)) of each series."""
    n = F.col("n")
    last = n - 1
    picks = {f"p{int(q * 100)}": F.least(F.floor(F.lit(q) * n), last) for q in (0.5, 0.95, 0.99)}
    return quantile_rank(df, [by], value, picks).join(df.groupBy(by).agg(F.avg(value).alias("mean")), by)


def burn_rate(df: DataFrame, by: list[str], latency: Column, ok: Column, target_ms: float = 150.0, success: float = 0.995, least: int = 12) -> DataFrame:
    """Share of breaches and failures over what the objective allows; 0 below least samples."""
    bad = F.sum((latency > target_ms).cast("int")) + F.sum((~ok).cast("int"))
    rate = bad / F.count("*") / max(1 - success, 1e-4)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") < least, F.lit(0.0)).otherwise(rate).alias("burn_rate"), F.avg(ok.cast("int")).alias("success_rate"))


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def self_time(spans: DataFrame) -> DataFrame:
    """Spans with self_ms: their time less their children's."""
    children = spans.where("parent_id is not null").groupBy(F.col("parent_id").alias("span_id")).agg(F.sum("ms").alias("children_ms"))
    return spans.join(children, "span_id", "left").withColumn("self_ms", F.greatest(F.lit(0.0), F.col("ms") - F.coalesce("children_ms", F.lit(0.0)))).drop("children_ms")


def slowest(spans: DataFrame, k: int) -> DataFrame:
    """The k longest traces with the span that takes most time itself."""
    own = self_time(spans)
    roots = own.where("parent_id is null").select("trace_id", F.col("ms").alias("total_ms"))
    hot = own.groupBy("trace_id").agg(F.max_by("name", F.struct("self_ms", -F.col("span_id"))).alias("hotspot"))
    return roots.orderBy(F.desc("total_ms"), "trace_id").limit(k).join(hot, "trace_id")


def flatten_spans(spans: DataFrame, depth: int = 8) -> DataFrame:
    """Spans with their depth below the root, level by level."""
    level = spans.where("parent_id is null").select("span_id", "trace_id", "name", F.lit(0).alias("depth"))
    out = level
    children = spans.where("parent_id is not null").select("span_id", "trace_id", "name", "parent_id")
    for d in range(1, depth + 1):
        level = children.join(level.select(F.col("span_id").alias("parent_id")), "parent_id").select("span_id", "trace_id", "name", F.lit(d).alias("depth"))
        out = out.union(level)
    return out


def prometheus(df: DataFrame, name: Column, value: Column) -> DataFrame:
    return df.select(F.concat(F.lit("engram_"), F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_"), F.lit(" "), value.cast("string")).alias("line"))


def link_state(loss: Column, rtt: Column, jitter: Column, metered: Column) -> Column:
    return F.when(loss > 0.6, "offline").when((loss > 0.15) | (rtt > 320) | (jitter > 90), "degraded").when(metered, "metered").otherwise("healthy")


def should_escalate(score: Column, link: Column, rtt: Column, may_egress: Column, complex_query: Column, endpoint: bool = True, floor: float = 0.62, most_rtt: float = 180.0) -> Column:
    """The first check that stands against a remote call, or "escalate"."""
    return (
        F.when(~F.lit(endpoint), "no_endpoint")
        .when(link == "offline", "offline")
        .when(~may_egress, "policy")
        .when(rtt > most_rtt, "slow_link")
        .when((score >= floor) & ~complex_query, "confident")
        .otherwise("escalate")
    )


def battery_answers(joules_per_answer: Column, watt_hours: float = 50.0) -> Column:
    """Answers per one percent of a battery."""
    return F.when(joules_per_answer > 0, F.floor(F.lit(watt_hours * 3600 * 0.01) / joules_per_answer))
