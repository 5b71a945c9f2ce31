"""Operation logs: last-writer-wins, merge classes, reconciliation, causal order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clocks import hlc
from .storage import latest, written


def _clock() -> Column:
    return hlc(F.col("wall_ms"), F.col("counter"), F.col("device_id"))


def heads(ops: DataFrame) -> DataFrame:
    """The operation with the greatest clock of each point; the first by id on equal clocks."""
    return latest(ops, "point_id", [F.col("wall_ms"), F.col("counter"), F.col("device_id"), -F.col("op_id")])


def materialise(ops: DataFrame) -> DataFrame:
    return heads(ops).where("kind <> 'delete'")


def merge_classes(ops: DataFrame, arrival: str = "op_id", close_ms: int = 1000) -> DataFrame:
    """class of each operation against the head before it in arrival order: accepted, conflicted
    (lost within close_ms) or dropped. Equal arrivals come by op_id; repeated op_ids count once."""
    w = Window.partitionBy("point_id").orderBy(arrival, "op_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(_clock()).over(w)
    seen = ops.dropDuplicates(["op_id"]).withColumn("_head", before)
    won = F.col("_head").isNull() | (_clock() > F.col("_head"))
    close = F.abs(F.col("wall_ms") - F.col("_head.wall_ms")) < close_ms
    return seen.withColumn("class", F.when(won, "accepted").when(close, "conflicted").otherwise("dropped")).drop("_head")


def conflict_ladder(pairs: DataFrame, local_trust: float = 1.0) -> DataFrame:
    """rung, resolution of local_* and remote_* clocks with trust and similarity: clocks far
    apart, then trust, then like content, then a person."""
    local = hlc(F.col("local_ms"), F.col("local_counter"), F.col("local_node"))
    remote = hlc(F.col("remote_ms"), F.col("remote_counter"), F.col("remote_node"))
    trust = F.lit(local_trust) - F.col("trust")
    rung = F.when(F.abs(F.col("remote_ms") - F.col("local_ms")) >= 250, "hlc").when(F.abs(trust) >= 0.15, "trust").when(F.col("similarity") >= 0.82, "semantic").otherwise("human")
    remote_wins = F.when(rung == "hlc", remote > local).otherwise(trust < 0)
    return pairs.withColumn("rung", rung).withColumn("resolution", F.when(rung == "semantic", "merged").when(rung == "human", "human_review").when(remote_wins, "remote_wins").otherwise("local_wins"))


def review(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts left to a person take that person's choice. decisions: point_id, keep."""
    joined = records.join(decisions.select("point_id", "keep"), "point_id", "left")
    decided = (F.col("resolution") == "human_review") & F.col("keep").isNotNull()
    return joined.withColumns({"resolution": F.when(decided, F.when(F.col("keep") == "remote", "remote_wins").otherwise("local_wins")).otherwise(F.col("resolution")), "reviewed": decided}).drop("keep")


def log_diff(a: DataFrame, b: DataFrame, key: str = "op_id") -> DataFrame:
    """key, side of what only one of two logs has."""
    return a.join(b, key, "left_anti").select(key, F.lit("only_a").alias("side")).union(b.join(a, key, "left_anti").select(key, F.lit("only_b").alias("side")))


def admit(ops: DataFrame, now_ms: int, ahead_ms: int = 3_600_000, refused: Column | None = None) -> DataFrame:
    """Remote operations that may enter: not stamped too far ahead, not refused by policy."""
    out = ops.where(F.col("wall_ms") <= now_ms + ahead_ms)
    return out if refused is None else out.where(~F.coalesce(refused, F.lit(False)))


def shareable(local: DataFrame, learned: DataFrame, allowed: Column) -> DataFrame:
    return local.unionByName(learned).dropDuplicates(["op_id"]).where(allowed)


# ------------------------------------------------------------- digests, sketches


def bucket(key: Column, fanout: int) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % fanout).cast("int")


def merkle(items: DataFrame, fanout: int = 64, key: str = "id", version: str = "version") -> DataFrame:
    """bucket, n, digest. A bucket's digest is the exclusive or of its items' digests and their
    number, so items are combined before the shuffle and never gathered."""
    item = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(version).cast("string")), 256)
    halves = [F.conv(F.substring(item, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = items.select(bucket(F.col(key), fanout).alias("bucket"), *halves)
    per = rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.bit_xor(f"h{i}").alias(f"h{i}") for i in range(4)])
    return per.select("bucket", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"h{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def merkle_root(digest: DataFrame) -> DataFrame:
    """One row: root over the digests of all buckets (a fixed number), by bucket."""
    one = digest.agg(F.array_sort(F.collect_list(F.struct("bucket", "digest"))).alias("d"))
    return one.select(F.sha2(F.array_join(F.transform("d", lambda x: F.concat(x["bucket"].cast("string"), F.lit("="), x["digest"])), ","), 256).alias("root"))


def divergent(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("bucket", F.col("digest").alias("da")), b.select("bucket", F.col("digest").alias("db"))
    return x.join(y, "bucket", "full_outer").where(~F.col("da").eqNullSafe(F.col("db"))).select("bucket")


def iblt_size(difference: Column) -> Column:
    """Cells for an expected difference: the next power of two of four times it, 32 at least."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(32), 4 * difference).cast("double")))).cast("long")


def iblt_places(key: Column, cells: int, hashes: int) -> Column:
    return F.array(*[(F.pmod(F.xxhash64(key.cast("string"), F.lit(i)), F.lit(cells // hashes)) + i * (cells // hashes)).cast("int") for i in range(hashes)])


def iblt_cells(keys: DataFrame, cells: int, key: str = "op_id", hashes: int = 4, parts: int = 1) -> DataFrame:
    """part, cell, n, key_xor, check_xor: invertible sketches of a key set, one for each part that
    a hash deals the keys to, combined before the shuffle."""
    h = F.xxhash64(F.col(key).cast("string"))
    rows = keys.select(F.pmod(F.xxhash64(h, F.lit(99)), F.lit(parts)).cast("int").alias("part"), F.col(key).cast("long").alias("k"), h.alias("c"), F.explode(iblt_places(F.col(key), cells, hashes)).alias("cell"))
    return rows.groupBy("part", "cell").agg(F.count("*").alias("n"), F.bit_xor("k").alias("key_xor"), F.bit_xor("c").alias("check_xor"))


def iblt_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of what one side only holds: n is positive for a, negative for b."""
    both = a.select("part", "cell", "n", "key_xor", "check_xor").union(b.select("part", "cell", -F.col("n"), "key_xor", "check_xor"))
    return both.groupBy("part", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key_xor").alias("key_xor"), F.bit_xor("check_xor").alias("check_xor"))


def iblt_peel(cells: DataFrame, size: int, keep, hashes: int = 4, rounds: int = 60) -> tuple[DataFrame, bool]:
    """key, sign of the keys that the subtracted cells hold, and whether all are found. Each round
    takes the cells with one key and takes these keys out of all their cells; keep(df) writes a
    round's table. All is done by part in joins: nothing but a flag comes to the driver."""
    found, left = None, keep(cells)
    for _ in range(rounds):
        pure = left.where((F.abs("n") == 1) & (F.xxhash64(F.col("key_xor").cast("string")) == F.col("check_xor"))).groupBy("part", "key_xor").agg(F.max("n").alias("sign"))
        pure = keep(pure)
        if pure.isEmpty():
            break
        found = pure if found is None else found.union(pure)
        out = pure.select("part", F.explode(iblt_places(F.col("key_xor"), size, hashes)).alias("cell"), (-F.col("sign")).alias("n"), "key_xor", F.xxhash64(F.col("key_xor").cast("string")).alias("check_xor"))
        both = left.select("part", "cell", "n", "key_xor", "check_xor").union(out)
        left = keep(both.groupBy("part", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key_xor").alias("key_xor"), F.bit_xor("check_xor").alias("check_xor")).where("n <> 0 or key_xor <> 0 or check_xor <> 0"))
    if found is None:
        found = left.select("part", "key_xor", F.col("n").alias("sign")).where(F.lit(False))
    return found.select(F.col("key_xor").alias("key"), "sign"), left.where("n <> 0 or key_xor <> 0 or check_xor <> 0").isEmpty()


def duplicates(df: DataFrame, key: str = "op_id") -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def not_monotonic(df: DataFrame, by: str = "device_id", order: str | list[str] = "op_id") -> DataFrame:
    """Rows whose clock does not exceed the one before."""
    w = Window.partitionBy(by).orderBy(*([order] if isinstance(order, str) else order))
    c = _clock()
    return df.withColumn("_prev", F.lag(c).over(w)).where(F.col("_prev").isNotNull() & ~(c > F.col("_prev"))).drop("_prev")


def poisoned(df: DataFrame, now_ms: int, ahead_ms: int = 86_400_000) -> DataFrame:
    return df.where(F.col("wall_ms") > now_ms + ahead_ms)


def missing(authored: DataFrame, log: DataFrame, key: str = "op_id") -> DataFrame:
    return authored.join(log, key, "left_anti")


# --------------------------------------------------------------------- causal


def causal_release(ops: DataFrame, stream: str, seq: str = "arrival", key: str = "op_id") -> DataFrame:
    """ops with delivered: the 1-based place at which their stream delivers them, null for what stays
    held. An operation (sender, clock map<string,int>) waits for its sender's one before and for
    all that its clock names; it is released by the last arrival among these. What one arrival
    releases comes by the sum of clocks, then by arrival, which keeps causes before effects.

    Nothing is replayed: a clock names all that is before it, so the releasing arrival is a
    maximum over the entries of the latest arrival among a sender's first operations. A clock that
    misses what its own causes name is completed first, a round for each missing link of a chain.

    Of rows that claim one place of a sender the first to arrive stands for it and the others
    stay held, as do rows without a place (null sender or clock, an entry below 1), operations that
    wait for each other, and all behind such ones or behind a gap. Equal arrivals come by key."""
    kind = T.MapType(T.StringType(), T.IntegerType())
    rows = ops.select(
        F.struct(*[F.col(f"`{c}`") for c in ops.columns]).alias("row"), F.struct(stream).alias("s"), F.col("sender").alias("k"),
        F.map_filter(F.coalesce(F.col("clock").cast(kind), F.create_map().cast(kind)), lambda _, v: v > 0).alias("c"),
        F.struct(F.col(seq).alias("a"), F.col(key).alias("o"), F.monotonically_increasing_id().alias("i")).alias("pos"),
    ).withColumn("n", F.try_element_at("c", F.col("k")))
    rows = written(rows, "causal-rows")
    first = F.row_number().over(Window.partitionBy("s", "k", "n").orderBy("pos"))
    slots = rows.where("n is not null").select("s", "k", "n", "c", "pos", first.alias("_first")).where("_first = 1").drop("_first")
    chain = Window.partitionBy("s", "k").orderBy("n")
    slots = slots.select("*", F.row_number().over(chain).alias("_at"), F.max("pos").over(chain).alias("latest")).where("_at = n").drop("_at")
    slots = _completed(written(slots, "causal-slots"))
    bad = slots.where("cyclic").groupBy("s", "k").agg(F.min("n").alias("end"))
    good = slots.join(bad, ["s", "k"], "left").where("end is null or n < end").select("s", F.col("k").alias("dk"), F.col("n").alias("dv"), "latest")
    total = F.aggregate(F.map_values("c"), F.lit(0).cast("long"), lambda x, v: x + v)
    named = slots.where("not cyclic").withColumn("total", total).select("s", "k", "n", F.struct("pos", "total").alias("own"), F.explode("c").alias("dk", "dv"))
    found = named.join(good, ["s", "dk", "dv"], "left").groupBy("s", "k", "n").agg(F.max("own").alias("own"), F.max("latest").alias("r"), F.count("latest").alias("there"), F.count("*").alias("all"))
    free = found.where("there = all").select("s", F.col("own.pos.i").alias("i"), F.struct("r", F.col("own.total"), F.col("own.pos")).alias("at"))
    placed = ranked(free, "s", ["at"], "delivered").select("i", F.col("delivered").cast("int").alias("delivered"))
    return rows.select("row", F.col("pos.i").alias("i")).join(placed, "i", "left").select("row.*", "delivered")


def _completed(slots: DataFrame) -> DataFrame:
    """Clocks with all that the operations they name have named; cyclic: whether one of these
    names the operation itself."""
    while True:
        before = F.transform(F.when(F.col("n") > 1, F.array(F.col("n") - 1)).otherwise(F.array().cast("array<int>")), lambda v: F.struct(F.col("k").alias("dk"), v.alias("dv")))
        others = F.transform(F.filter(F.map_entries("c"), lambda e: e["key"] != F.col("k")), lambda e: F.struct(e["key"].alias("dk"), e["value"].alias("dv")))
        edges = slots.select("s", "k", "n", F.inline(F.concat(others, before)))
        causes = slots.select("s", F.col("k").alias("dk"), F.col("n").alias("dv"), F.col("c").alias("dc"))
        heard = edges.join(causes, ["s", "dk", "dv"]).select("s", "k", "n", F.explode("dc").alias("hk", "hv")).groupBy("s", "k", "n", "hk").agg(F.max("hv").alias("hv"))
        heard = heard.groupBy("s", "k", "n").agg(F.map_from_entries(F.collect_list(F.struct("hk", "hv"))).alias("h"))
        own = F.coalesce(F.try_element_at("h", F.col("k")), F.lit(0)) >= F.col("n")
        news = F.coalesce(F.map_filter("h", lambda k, _: k != F.col("k")), F.create_map().cast("map<string,int>"))
        full = F.map_zip_with("c", news, lambda _, a, b: F.greatest(a, b))
        told = slots.drop("cyclic", "moved").join(heard, ["s", "k", "n"], "left").withColumn("full", full)
        told = told.select("s", "k", "n", "pos", "latest", F.col("full").alias("c"), F.coalesce(own, F.lit(False)).alias("cyclic"), F.exists(F.map_entries("full"), lambda e: e["value"] > F.coalesce(F.try_element_at("c", e["key"]), F.lit(0))).alias("moved"))
        slots = written(told, "causal-clocks")
        if slots.where("moved").isEmpty():
            return slots


def ranked(df: DataFrame, by: str, order: list[str], name: str = "rank") -> DataFrame:
    """df with the 1-based place of each row among those of one key. Rows are dealt by ranges, so a
    key of any size lies in many tasks, and places are counted on from task to task."""
    at = written(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    per = at.groupBy(by, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), (before - F.col("_low") + 1).alias("_shift"))
    both = at.join(per, at[by].eqNullSafe(per["_by"]) & (at["_part"] == per["_of"]))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name))
