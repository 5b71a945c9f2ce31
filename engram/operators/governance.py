"""Sensitivity, policy, redaction, egress and audit."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

# Ranks, patterns and weights decide the results.
SENSITIVITY = ("public", "internal", "sensitive", "restricted")
SYNC_CLASSES = ("sync_full", "sync_after_redaction", "sync_metadata_only", "local_only")
#: name, pattern, class, in order; (?U) lets \w and \b know letters beyond ASCII.
SIGNALS = [
    ("email", r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.]+", "restricted"),
    ("phone", r"(?<!\d)(?:\+\d{1,3}[\s-]?)?(?:\d[\s-]?){9,13}\d(?!\d)", "restricted"),
    ("national_id", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{4}\s?\d{4}\s?\d{4}\b", "restricted"),
    ("card", r"\b(?:\d[ -]?){13,16}\b", "restricted"),
    ("coords", r"-?\d{1,3}\.\d{4,},\s*-?\d{1,3}\.\d{4,}", "sensitive"),
    ("credential", r"(?i)\b(password|api[_ -]?key|secret|token|bearer)\b", "restricted"),
    ("operator", r"(?i)\boperator\s+(id\s+)?[a-z]?\d{2,}\b", "sensitive"),
    ("internal", r"(?i)\b(internal|confidential|do not share)\b", "sensitive"),
]
MASKS = [
    ("EMAIL", r"(?U)(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.]+"),
    ("PHONE", r"(?<!\d)(?:\+\d{1,3}[\s-]?)?(?:\d[\s-]?){9,13}\d(?!\d)"),
    ("CARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("ID", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("GEO", r"-?\d{1,3}\.\d{4,},\s*-?\d{1,3}\.\d{4,}"),
    ("SECRET", r"(?i)(?:api[_ -]?key|token|password|secret)\s*[=:]\s*\S+"),
    ("OPERATOR", r"(?i)\boperator\s+(?:id\s+)?[a-z]?\d{2,}\b"),
]
WINDOW, OVERLAP = 64 * 1024, 1024
#: Value of an operation beyond the base of 1.
OBLIGATION, REDACTION, REPAIR, DEMAND, PINNED = 40.0, 24.0, 12.0, 6.0, 8.0


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for i, v in enumerate(order):
        out = F.when(value == v, i).otherwise(out)
    return out


def sensitivity_rank(value: Column) -> Column:
    return _rank(value, SENSITIVITY)


def sync_rank(value: Column) -> Column:
    """The higher, the stricter."""
    return _rank(value, SYNC_CLASSES)


def strictest(values: list[Column]) -> Column:
    rank = reduce(F.greatest, [sync_rank(v) for v in values]) if len(values) > 1 else sync_rank(values[0])
    return F.get(F.array(*[F.lit(c) for c in SYNC_CLASSES]), rank)


def windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Overlapping slices, so that no pattern sees an unbounded text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def classify(text: Column) -> Column:
    """struct(sensitivity, signals, confidence). More than three words and no signal: internal."""
    whole = F.length(text) <= WINDOW
    slices = F.when(~whole, windows(text))

    def seen(pattern: str) -> Column:
        return F.when(whole, text.rlike(pattern)).otherwise(F.exists(slices, lambda w: w.rlike(pattern)))

    hits = [F.when(seen(p), F.lit(n)) for n, p, _ in SIGNALS]
    found = F.array_compact(F.array(*hits))
    strong = F.arrays_overlap(found, F.array(*[F.lit(n) for n, _, c in SIGNALS if c == "restricted"]))
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    level = F.when(strong, "restricted").when(F.size(found) > 0, "sensitive").when(words > 3, "internal").otherwise("public")
    confidence = F.when(F.size(found) > 0, F.least(F.lit(0.99), 0.62 + 0.12 * F.size(found))).otherwise(0.55)
    return F.struct(level.alias("sensitivity"), found.alias("signals"), confidence.alias("confidence"))


def token_for(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{kind}:"), F.substring(F.sha2(value, 256), 1, 12), F.lit(">"))


def _masked(kind: str, parts: Column, found: Column) -> Column:
    """The pieces between matches with a token in place of each match."""
    pairs = F.arrays_zip(parts.alias("p"), found.alias("m"))
    return F.aggregate(pairs, F.lit(""), lambda acc, x: F.concat(acc, x["p"], F.when(x["m"].isNull(), F.lit("")).otherwise(token_for(kind, x["m"]))))


def redact_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the masks applied to the text one after the other, each match replaced by a token
    of its value; kinds of the matches, and tokens, the vault: array<struct<token, value>>. Filters
    on these columns belong after a table or a checkpoint: pushed down, they would repeat masks."""
    out = df.withColumns({"kinds": F.array().cast("array<string>"), "tokens": F.array().cast("array<struct<token:string,value:string>>")})

    def one(rows: DataFrame, kind: str, pattern: str) -> DataFrame:
        rows = rows.withColumn("_m", F.when(F.col(text).rlike(pattern), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
        hit = F.col("_m").isNotNull()
        pairs = F.transform("_m", lambda m: F.struct(token_for(kind, m).alias("token"), m.alias("value")))
        return rows.withColumns(
            {
                text: F.when(hit, _masked(kind, F.split(F.col(text), pattern, -1), F.col("_m"))).otherwise(F.col(text)),
                "kinds": F.when(hit, F.concat("kinds", F.transform("_m", lambda m: F.lit(kind)))).otherwise(F.col("kinds")),
                "tokens": F.when(hit, F.concat("tokens", pairs)).otherwise(F.col("tokens")),
            }
        )

    for kind, pattern in MASKS:
        out = one(out, kind, pattern)
    return out.drop("_m")


def resolve(text: Column, tokens: Column) -> Column:
    """Puts the values back."""
    return F.aggregate(F.reverse(tokens), text, lambda acc, t: F.replace(acc, t["token"], t["value"]))


@dataclass(frozen=True)
class Rule:
    name: str
    when: dict
    then: dict = field(default_factory=dict)


# The rules in force where none are given, first match first.
DEFAULT = {"sync_class": "sync_full", "ttl_days": 90, "redact": False, "pin": False}
RULES = [
    Rule("restricted-stays-home", {"sensitivity": "restricted"}, {"sync_class": "local_only", "ttl_days": 30}),
    Rule("sensitive-redacted-egress", {"sensitivity": "sensitive"}, {"sync_class": "sync_after_redaction", "ttl_days": 60, "redact": True}),
    Rule("sensor-telemetry-metadata-only", {"collection": "sensor"}, {"sync_class": "sync_metadata_only", "ttl_days": 14}),
    Rule("procedures-are-fleet-knowledge", {"collection": "procedural"}, {"sync_class": "sync_full", "ttl_days": 365, "pin": True}),
]
STRIPPED_KEYS = ("operator", "device_serial", "gps_raw")


def rule_matches(rule: Rule, columns: list[str]) -> Column:
    tests = []
    for key, expected in rule.when.items():
        if key == "min_confidence":
            tests.append(F.col("confidence") >= float(expected))
        elif key == "source_prefix":
            tests.append(F.coalesce(F.col("source"), F.lit("")).startswith(str(expected)))
        elif key in columns:
            tests.append(F.col(key) == expected)
        else:
            tests.append(F.lit(False) if "payload" not in columns else F.col("payload")[key] == expected)
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def decide(df: DataFrame, rules: list[Rule] = RULES, default: dict = DEFAULT) -> DataFrame:
    """df with rule, sync_class, ttl_s, redact and pin of the first rule that matches."""
    out = {k: F.lit(v) for k, v in default.items()} | {"rule": F.lit("default")}
    for rule in reversed(rules):
        own = default | rule.then | {"rule": rule.name}
        hit = rule_matches(rule, df.columns)
        out = {k: F.when(hit, F.lit(own[k])).otherwise(out[k]) for k in out}
    return df.withColumns({"rule": out["rule"], "sync_class": out["sync_class"], "ttl_s": out["ttl_days"].cast("double") * 86400, "redact": out["redact"], "pin": out["pin"]})


def may_egress() -> Column:
    return F.col("sync_class").isin(*SYNC_CLASSES[:3]) & (F.col("sensitivity") != "restricted")


def egress_body(df: DataFrame, payload: str = "payload") -> DataFrame:
    """What may leave: metadata only, or text (redacted where the decision says so) with keys
    stripped from the payload. Rows that may not leave are dropped."""
    out = df.where(may_egress())
    meta = F.col("sync_class") == "sync_metadata_only"
    kept = F.map_filter(payload, lambda k, v: ~k.isin(*STRIPPED_KEYS))
    masked = redact_rows(out.withColumn("_plain", F.col("text"))).withColumnRenamed("text", "_masked").withColumnRenamed("_plain", "text")
    return masked.select(
        "id",
        "sync_class",
        F.when(~meta, F.when(F.col("redact"), F.col("_masked")).otherwise(F.col("text"))).alias("text"),
        F.when(~meta, kept).alias("payload"),
        meta.alias("metadata_only"),
        (F.col("redact") & ~meta).alias("redacted"),
    )


# ---------------------------------------------------------------------- audit


def audit_hash(prev: Column, seq: Column, action: Column, subject: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, seq.cast("string"), action, subject), 256)


def audit_chain(rows: DataFrame, block: int) -> DataFrame:
    """seq, action, subject, prev_hash, hash. A chain is sequential, so each block of numbers has
    one of its own, which begins with an empty hash; blocks are chained by audit_heads(). A block
    is one task's at most, blocks run in parallel."""
    import hashlib

    import pyarrow as pa

    def chain(table: pa.Table) -> pa.Table:
        table, before, prev, own = table.sort_by("seq"), "", [], []
        for seq, action, subject in zip(*(table.column(c).to_pylist() for c in ("seq", "action", "subject"))):
            prev.append(before)
            before = hashlib.sha256("|".join(x for x in (before, str(seq), action, subject) if x is not None).encode()).hexdigest()
            own.append(before)
        return table.append_column("prev_hash", pa.array(prev, pa.string())).append_column("hash", pa.array(own, pa.string()))

    named = rows.select(F.col("seq").cast("long").alias("seq"), "action", "subject")
    return named.groupBy(F.expr(f"seq div {block}")).applyInArrow(chain, "seq long, action string, subject string, prev_hash string, hash string")


def audit_heads(log: DataFrame, block: int, levels: int | None = None) -> DataFrame:
    """level, block, hash: the last hash of every block of entries (level 0), and of the chains over
    the blocks' hashes, block by block again, until one is left. A changed block changes all above it.
    levels: how many levels may lie above the blocks; the last of them is a single chain however many
    hashes it has, and so a single task, over one hash for each block."""
    level, out = 0, None
    heads = log.groupBy(F.expr(f"seq div {block}").alias("block")).agg(F.max_by("hash", "seq").alias("hash"))
    while True:
        heads = written(heads, "audit-heads")
        own = heads.select(F.lit(level).alias("level"), "block", "hash")
        out = own if out is None else out.union(own)
        if heads.count() <= 1:
            return out
        level += 1
        wide = block if levels is None or level < levels else heads.agg(F.max("block")).first()[0] + 1
        above = audit_chain(heads.select(F.col("block").alias("seq"), F.col("hash").alias("action"), F.lit(None).cast("string").alias("subject")), wide)
        heads = above.groupBy(F.expr(f"seq div {wide}").alias("block")).agg(F.max_by("hash", "seq").alias("hash"))


def audit_verify(log: DataFrame, block: int) -> DataFrame:
    """block, entries, first_broken, ok. Each entry meets its predecessor by number, so no chain is
    followed in one task."""
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    joined = log.join(before, "seq", "left")
    expected = F.when(F.col("seq") % block == 0, F.lit("")).otherwise(F.col("_before"))
    broken = ~(F.col("prev_hash").eqNullSafe(expected) & audit_hash(F.col("prev_hash"), F.col("seq"), F.col("action"), F.col("subject")).eqNullSafe(F.col("hash")))
    each = joined.groupBy(F.expr(f"seq div {block}").alias("block")).agg(F.count("*").alias("entries"), F.min(F.when(broken, F.col("seq"))).alias("first_broken"))
    return each.withColumn("ok", F.col("first_broken").isNull())


# --------------------------------------------------------------------- egress


def op_value(divergent: Column) -> Column:
    """Worth of an operation joined to its point (kind, redacted, metadata_only, access_count, pinned, confidence)."""
    reads = F.coalesce(F.col("access_count"), F.lit(0))
    value = (
        1.0
        + F.when(F.col("kind") == "delete", OBLIGATION).when(F.col("redacted") | F.col("metadata_only"), REDACTION).otherwise(0.0)
        + F.when(divergent, REPAIR).otherwise(0.0)
        + F.when(reads > 0, DEMAND * F.log1p(reads.cast("double"))).otherwise(0.0)
        + F.when(F.coalesce("pinned", F.lit(False)), PINNED).otherwise(0.0)
    )
    c = F.coalesce("confidence", F.lit(1.0))
    return F.when(c < 0.6, value * (0.6 + c)).otherwise(value)


def op_bytes(*columns: str) -> Column:
    return F.octet_length(F.to_json(F.struct(*[F.col(c) for c in columns])))


def suppress(ops: DataFrame) -> DataFrame:
    """ops with keeper: the newest upsert of the point, which makes older upserts redundant;
    null for survivors. Deletes are never suppressed."""
    clock = F.struct("wall_ms", "counter", "device_id", "op_id")
    newest = ops.where("kind <> 'delete'").groupBy("point_id").agg(F.max_by("op_id", clock).alias("_newest"))
    return ops.join(newest, "point_id", "left").withColumn("keeper", F.when((F.col("kind") != "delete") & (F.col("_newest") != F.col("op_id")), F.col("_newest"))).drop("_newest")


def running_budget(df: DataFrame, by: list[str], order: list[Column], amount: str, total: float) -> DataFrame:
    """Privacy budget: an expense is granted while the sum so far stays within the total."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("granted", F.sum(amount).over(w) <= total)
