"""A bitemporal knowledge graph: liveness, neighbours, paths, activation, corroboration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of entities and relations, in order of precedence.
ENTITIES = [
    ("part", r"\b([A-Z]{2,4}-\d{3,5}(?:-[A-Z0-9]{1,3})?)\b", 0.95),
    ("location", r"(?i)\b(bay\s?\d+|line\s?\d+|cell\s?\d+|zone\s?[a-z0-9]+|console\s?\d+|mast\s?\w*)\b", 0.9),
    ("asset", r"(?i)\b(conveyor|gantry|spindle|drive|bearing|pump|valve|servo|relay|interlock|compressor|actuator)\b", 0.8),
    ("metric", r"(?i)\b(pressure|vibration|temperature|torque|current|voltage|flow|speed|humidity|tension)\b", 0.75),
    ("person", r"(?i)\b(operator\s+(?:id\s+)?[a-z]?\d{2,})\b", 0.9),
    ("threshold", r"\b(\d+(?:\.\d+)?)\s*(mm/s|bar|nm|rpm|°?c|hz|kw|v|a)\b", 0.85),
]
RELATIONS = [
    ("exceeded", r"(?i)\b(crossed|exceeded|above|over|climbed to|rose to)\b"),
    ("below", r"(?i)\b(below|under|dropped to|fell to|read)\b"),
    ("located_in", r"(?i)\b(in|on|at)\b"),
    ("replaced", r"(?i)\b(replaced|swapped|changed|fitted)\b"),
    ("caused", r"(?i)\b(caused|triggered|fired|tripped|led to|resulted in)\b"),
    ("requires", r"(?i)\b(requires|needs|must|then|before|after)\b"),
    ("acknowledged", r"(?i)\b(acknowledged|confirmed|signed off|approved)\b"),
    ("measured", r"(?i)\b(measured|read|logged|recorded|reported)\b"),
]


def valid_at(t: Column) -> Column:
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def believed_at(t: Column) -> Column:
    return (F.col("recorded_at") <= t) & (F.col("retracted_at").isNull() | (t < F.col("retracted_at")))


def live(facts: DataFrame, valid: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """Facts that hold at a time and are believed at another; both axes half open, null is open."""
    out = facts if valid is None else facts.where(valid_at(valid))
    return out if as_of is None else out.where(believed_at(as_of))


def as_of(facts: DataFrame, valid: Column, believed: Column) -> DataFrame:
    """One row: facts and distinct entities at their ends."""
    own = live(facts, valid, believed)
    ends = own.select(F.explode(F.array("subject", "object")).alias("e")).agg(F.count_distinct("e").alias("entities"))
    return own.agg(F.count("*").alias("facts")).join(ends)


def diff(facts: DataFrame, earlier: Column, later: Column, keys: list[str]) -> DataFrame:
    """keys, change: learned, retracted or stable between two times of belief."""
    a, b = believed_at(earlier), believed_at(later)
    return facts.select(*keys, F.when(b & ~a, "learned").when(a & ~b, "retracted").when(a & b, "stable").alias("change")).where("change is not null")


def neighbours(facts: DataFrame, frontier: DataFrame, direction: str = "both") -> DataFrame:
    """Facts that touch the frontier's entities (column entity), each once."""
    f = frontier.select("entity").distinct()
    parts = []
    if direction in ("out", "both"):
        parts.append(facts.join(f.withColumnRenamed("entity", "subject"), "subject", "left_semi"))
    if direction in ("in", "both"):
        parts.append(facts.join(f.withColumnRenamed("entity", "object"), "object", "left_semi"))
    return reduce(DataFrame.unionByName, parts).distinct()


def adjacency(facts: DataFrame) -> DataFrame:
    """src, dst, confidence in both directions, the best edge of each pair."""
    both = facts.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "confidence").union(facts.select("object", "subject", "confidence"))
    return both.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def paths(edges: DataFrame, sources: DataFrame, hops: int = 2) -> DataFrame:
    """src, dst, hops, path, confidence of all simple paths of up to some hops from the sources
    (column entity); the confidence is the product of the edges'."""
    at = sources.select(F.col("entity").alias("src"), F.col("entity").alias("dst"), F.array("entity").alias("path"), F.lit(1.0).alias("confidence"))
    out = None
    step = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("confidence").alias("_c"))
    for n in range(1, hops + 1):
        at = at.join(step, F.col("dst") == F.col("_from")).where(~F.array_contains("path", F.col("_to")))
        at = at.select("src", F.col("_to").alias("dst"), F.concat("path", F.array("_to")).alias("path"), (F.col("confidence") * F.col("_c")).alias("confidence"))
        own = at.withColumn("hops", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def spreading_activation(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.55, least: float = 0.02) -> DataFrame:
    """entity, energy: what reaches each entity from the seeds (entity, energy) in a few hops,
    the most over single paths; what falls below least stops."""
    best = seeds.select("entity", "energy")
    front = best
    for _ in range(hops):
        moved = front.join(edges, F.col("entity") == F.col("src")).select(F.col("dst").alias("entity"), (F.col("energy") * decay * F.col("confidence")).alias("energy"))
        front = moved.where(F.col("energy") > least).groupBy("entity").agg(F.max("energy").alias("energy"))
        best = best.unionByName(front).groupBy("entity").agg(F.max("energy").alias("energy"))
    return best


def corroborate(facts: DataFrame) -> DataFrame:
    """One fact for each (subject, predicate, object): earliest start, number of provenances n and
    the confidence that n - 1 corroborations raise: 0.03 * (1 + 2 + ... + (n - 1)), 0.99 at most."""
    first = F.struct("recorded_at", "provenance", "line_no", "confidence")
    per = facts.groupBy("subject", "predicate", "object").agg(F.min("valid_from").alias("valid_from"), F.count_distinct("provenance").alias("n"), F.min_by("confidence", first).alias("c"))
    return per.withColumn("confidence", F.greatest(F.col("c"), F.least(F.lit(0.99), F.col("c") + 0.03 * F.col("n") * (F.col("n") - 1) / 2))).drop("c")


def retract(facts: DataFrame, dead: DataFrame, key: list[str], at: Column) -> DataFrame:
    """Closes the transaction time of facts; already retracted ones keep theirs."""
    mark = dead.select(*key).distinct().withColumn("_dead", F.lit(True))
    return facts.join(mark, key, "left").withColumn("retracted_at", F.when(F.col("_dead") & F.col("retracted_at").isNull(), at).otherwise(F.col("retracted_at"))).drop("_dead")


def forget(facts: DataFrame, points: DataFrame, at: Column) -> DataFrame:
    """Takes points out of provenance arrays; facts left without any are retracted.
    facts: provenance array; points: point."""
    gone = facts.select("fact_id", F.explode("provenance").alias("point")).join(points, "point", "left_semi").groupBy("fact_id").agg(F.collect_set("point").alias("_gone"))
    out = facts.join(gone, "fact_id", "left").withColumn("provenance", F.when(F.col("_gone").isNotNull(), F.array_except("provenance", "_gone")).otherwise(F.col("provenance")))
    return out.withColumn("retracted_at", F.when(F.col("_gone").isNotNull() & (F.size("provenance") == 0) & F.col("retracted_at").isNull(), at).otherwise(F.col("retracted_at"))).drop("_gone")


def supersede(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Losers point at their winners and lose half of their confidence. pairs: id, winner."""
    out = points.join(pairs.select("id", "winner"), "id", "left")
    return out.withColumns({"superseded_by": F.coalesce("winner", "superseded_by"), "confidence": F.when(F.col("winner").isNotNull(), F.col("confidence") * 0.5).otherwise(F.col("confidence"))}).drop("winner")


def points_for_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """id, mentions: how many of the entities a point mentions. mentions: entity, id."""
    return mentions.join(entities.select("entity").distinct(), "entity", "left_semi").groupBy("id").agg(F.count("*").alias("mentions"))


# ----------------------------------------------------------------- extraction


def _spans(text: Column, kind: str, pattern: str, confidence: float) -> Column:
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = "array<struct<s:int,e:int,kind:string,raw:string,confidence:double>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        one = F.array(F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), F.lit(kind).alias("kind"), x["m"].alias("raw"), F.lit(confidence).alias("confidence")))
        return F.struct(F.coalesce(s + F.length(x["m"]), s).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(F.arrays_zip(parts.alias("p"), found.alias("m")), start, step, lambda a: a["out"])).otherwise(F.array().cast(spans))


def extract_entities(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """id, n (order in the text), s, e, entity (kind:name), kind, confidence."""
    from ..functions.text import canonical

    spans = F.array_sort(F.concat(*[_spans(F.col(text), k, p, c) for k, p, c in ENTITIES]))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.posexplode(spans).alias("n", "x"))
    return rows.select("id", "n", "x.s", "x.e", F.concat("x.kind", F.lit(":"), canonical(F.col("x.raw"))).alias("entity"), "x.kind", "x.confidence", "text")


def predicate(between: Column, left: Column, right: Column) -> Column:
    """The first relation the words between two entities name, else what their kinds imply."""
    out = F.when((right == "threshold") & (left == "metric"), "measured").when(left.isin("asset", "part") & (right == "location"), "located_in").when((left == "location") & right.isin("asset", "part"), "contains")
    for name, pattern in reversed(RELATIONS):
        out = F.when(between.rlike(pattern), name).otherwise(out)
    return out


def extract_facts(docs: DataFrame, key: str = "id", text: str = "text", reach: int = 80) -> DataFrame:
    """id, subject, predicate, object, confidence of adjacent entities at most reach characters apart."""
    e = extract_entities(docs, key, text)
    nxt = e.select("id", (F.col("n") - 1).alias("n"), F.col("s").alias("s2"), F.col("entity").alias("object"), F.col("kind").alias("k2"), F.col("confidence").alias("c2"))
    pair = e.join(nxt, ["id", "n"]).where("entity <> object")
    between = F.when(F.col("s2") >= F.col("e"), F.substring("text", F.col("e") + 1, F.col("s2") - F.col("e"))).otherwise("")
    pair = pair.withColumn("between", between).where(F.length("between") <= reach).withColumn("predicate", predicate(F.col("between"), F.col("kind"), F.col("k2")))
    return pair.where("predicate is not null").select("id", F.col("entity").alias("subject"), "predicate", "object", (F.least("confidence", "c2") * 0.92).alias("confidence"))
