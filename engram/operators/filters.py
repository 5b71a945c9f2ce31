"""Filter trees over rows: conditions that are false on missing fields and never raise."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "ne", "in", "lt", "lte", "gt", "gte", "range", "exists", "contains")
#: Assumed where a field has no statistics, and where an operation has no estimate.
UNKNOWN_FIELD, OTHER_OP, LEAST = 0.5, 0.3, 1e-4


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None

    def column(self, df: DataFrame) -> Column:
        """True or false, never null. A field that df lacks is missing in every row."""
        if self.op not in OPS:
            raise ValueError(f"unknown operation {self.op}")
        known = self.field in df.columns
        c = F.col(f"`{self.field}`") if known else F.lit(None).cast("string")
        if self.op == "exists":
            return c.isNotNull() if self.value in (None, True) else c.isNull()
        if not known:
            return F.lit(False)
        kind = dict(df.dtypes)[self.field]
        if self.op == "contains":
            test = F.array_contains(c, self.value) if kind.startswith("array") else F.contains(c.cast("string"), F.lit(str(self.value)))
        elif self.op in ("lt", "lte", "gt", "gte", "range"):
            ends = self.value if self.op == "range" else (self.value, None)
            numbers = all(e is None or isinstance(e, (int, float)) and not isinstance(e, bool) for e in ends)
            if numbers and kind == "string":
                c = F.expr(f"try_cast(`{self.field}` AS double)")
            elif not numbers and kind != "string":
                return F.lit(False)  # values of different kinds do not compare
            if self.op == "range":
                low, high = ends
                test = (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high) & c.isNotNull()
            else:
                test = {"lt": c < self.value, "lte": c <= self.value, "gt": c > self.value, "gte": c >= self.value}[self.op]
        else:
            values = list(self.value) if self.op == "in" else [self.value]
            if kind == "string":
                values = [v for v in values if isinstance(v, str)]
            elif kind == "boolean":
                values = [v for v in values if isinstance(v, bool)]
            elif not kind.startswith("array"):
                values = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if not values:
                return c.isNotNull() if self.op == "ne" else F.lit(False)
            test = c.isin(values) if self.op == "in" else c == values[0] if self.op == "eq" else c != values[0]
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Filter:
    """must: all hold; should: one holds, if there are any; must_not: none holds."""

    must: tuple[Condition, ...] = ()
    should: tuple[Condition, ...] = ()
    must_not: tuple[Condition, ...] = ()

    def column(self, df: DataFrame) -> Column:
        parts = [c.column(df) for c in self.must]
        if self.should:
            parts.append(reduce(lambda a, b: a | b, [c.column(df) for c in self.should]))
        parts += [~c.column(df) for c in self.must_not]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column(df))

    @classmethod
    def parse(cls, spec: dict | None) -> Filter:
        """{"must": [...], ...} with conditions {"field", "op", "value"}, or shorthand: a list
        means in, a dict of operations means each of them, a scalar means eq."""
        spec = spec or {}
        if spec.keys() & {"must", "should", "must_not"}:
            return cls(*(tuple(_condition(c) for c in spec.get(k, ())) for k in ("must", "should", "must_not")))
        out: list[Condition] = []
        for name, value in spec.items():
            if isinstance(value, dict):
                out += [Condition(name, op, v) for op, v in value.items()]
            elif isinstance(value, (list, tuple, set)):
                out.append(Condition(name, "in", list(value)))
            else:
                out.append(Condition(name, "eq", value))
        return cls(must=tuple(out))


def _condition(c: dict | Condition) -> Condition:
    return c if isinstance(c, Condition) else Condition(c["field"], c.get("op", "eq"), c.get("value"))


def selectivity(df: DataFrame, conditions: dict[str, Filter | Condition]) -> DataFrame:
    """One row of the shares of rows that pass, by name, in one pass."""
    return df.agg(*[F.avg(c.column(df).cast("double")).alias(k) for k, c in conditions.items()])


def estimate(must: list[float], should: list[float] = (), must_not: list[float] = ()) -> float:
    """Share of rows of a tree from shares of its conditions, taken as independent."""
    out = 1.0
    for s in must:
        out *= s
    if should:
        out *= 1 - reduce(lambda a, s: a * (1 - s), should, 1.0)
    for s in must_not:
        out *= 1 - s
    return max(LEAST, min(1.0, out))


@dataclass
class Plan:
    kind: str
    selectivity: float
    matches: int
    fetch_k: int
    cost: float
    options: dict[str, float] = field(default_factory=dict)


#: Relative costs, in distance evaluations.
SCAN_POINT, ANN_POINT, FILTER_CHECK, INDEX_LOOKUP = 1.0, 0.06, 0.15, 0.02


def plan(corpus: int, k: int, ann: bool, matches: int | None = None, share: float = 1.0, conditions: int = 0) -> Plan:
    """The cheapest way to filter a vector search; advisory, since the scan filters exactly.
    matches: exact count if it is known."""
    if conditions == 0:
        return Plan("post_filter" if ann else "full_scan", 1.0, corpus, k, corpus * (ANN_POINT if ann else SCAN_POINT))
    exact = matches is not None
    if exact:
        share = matches / corpus if corpus else 0.0
        if not matches:
            return Plan("empty", 0.0, 0, 0, INDEX_LOOKUP)
    else:
        matches = max(1, round(share * corpus))
    fetch = min(corpus, max(k, int(k / max(share, 1e-3))))
    options = {"pre_filter": matches * SCAN_POINT + conditions * INDEX_LOOKUP} if exact else {}
    options["post_filter"] = fetch * ANN_POINT * (corpus / max(fetch, 1)) + fetch * FILTER_CHECK if ann else float("inf")
    options["full_scan"] = corpus * (SCAN_POINT + FILTER_CHECK)
    kind = min(options, key=options.get)
    return Plan(kind, share, matches, {"pre_filter": k, "post_filter": fetch}.get(kind, max(k, fetch)), options[kind], options)


def strategy_of(count: Column, pressure: Column | None = None, hnsw: int = 110_000, ivf: int = 1_000_000) -> Column:
    """Index kind for a corpus size; compressed where memory is what binds."""
    short = (pressure > 0.85) & (count > 2_000) if pressure is not None else F.lit(False)
    return F.when(short | (count >= ivf), "ivf_pq").when(count >= hnsw, "hnsw").otherwise("flat")


#: Points a graph walk visits for each step of its beam, as published.
VISITS = 5.6


def crossover_at(flat_ns: Column, hop_ns: Column, ef: int = 64, margin: float = 1.5) -> Column:
    """Smallest multiple of 10,000 rows at which a graph walk beats the scan by the margin, twenty
    million where none does."""
    step, most = 10_000, 20_000_000
    sizes = F.sequence(F.lit(step).cast("long"), F.lit(most).cast("long"), F.lit(step).cast("long"))
    wins = F.filter(sizes, lambda n: (F.lit(ef * VISITS) * F.log2(n) * hop_ns * margin < n * flat_ns) | (n == most))
    return F.element_at(wins, 1)


# row-level helpers -----------------------------------------------------------


def visible(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("superseded_by").isNull())


def namespace(tenant: Column, collection: Column) -> Column:
    return F.concat_ws("::", tenant, collection)


def pushable(spec: Filter) -> bool:
    """Whether a tree means the same as predicates of a Parquet scan: conditions that are false on
    missing fields by themselves. What is not is applied after the scan, with the same result."""
    exact = {"eq", "in", "lt", "lte", "gt", "gte", "range", "exists"}
    return not spec.must_not and not spec.should and all(c.op in exact for c in spec.must)


def spec_key(*fields: str) -> Column:
    """A digest of the equality filter on a row's own values of some fields, the same in whatever
    order they are named."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256)


def filter_key(spec: dict | None) -> str:
    """A digest of a filter in any notation: equal for specs that differ in order only."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple, set, frozenset)) else x

    return hashlib.sha256(json.dumps(plain(spec or {}), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
