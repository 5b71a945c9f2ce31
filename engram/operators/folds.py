"""Folds over ordered observations as parallel scans.

What a step gives depends on the one before, yet a long series need not wait in one task. Rows
are dealt in blocks by ranges of (key, order), so a key of any length lies in as many blocks as
it needs, and the blocks are checkpointed. First all blocks tell, in parallel, what they do to
the state they begin with: a function of that state (Fold.summary) for a key that may go on from
the block before, and the state they end with for the key that may go on after. The few block
summaries are composed in order, which gives each block the state it starts from; then all
blocks run in parallel. A block whose summary has no answer for the state that reaches it is run
from that state (a job for all such blocks at once) before those behind it go on.

A null key is a key like others; rows with equal order come in any order. Memory is bounded by a
block of BLOCK_ROWS rows (more only where that many rows tie in key and order).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import shared_folder

BLOCK_ROWS = 100_000
#: Pieces of a function of the start state before a block is run from its true start instead.
PIECES = 4096
_UNKNOWN = ("unknown",)


class Fold:
    """columns: what a step reads, in this order. step gives the next state and the row's result;
    summary a function from a start state to the end state (_UNKNOWN where it can't tell)."""

    columns: list[str]

    def fresh(self):
        raise NotImplementedError

    def step(self, state, row: tuple):
        raise NotImplementedError

    def summary(self, rows: list[tuple]) -> Callable:
        raise NotImplementedError

    def run(self, state, rows: list[tuple]):
        """The end state and each row's result."""
        out = []
        for r in rows:
            state, result = self.step(state, r)
            out.append(result)
        return state, out


def _same(a, b) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def _series(table: pa.Table, key: str, columns: list[str]) -> list[tuple]:
    """(key, first, rows) of each key's run."""
    rows = list(zip(*[table.column(c).to_pylist() for c in columns])) if columns else [()] * len(table)
    keys, out, at = table.column(key).to_pylist(), [], 0
    while at < len(keys):
        end = at + 1
        while end < len(keys) and _same(keys[end], keys[at]):
            end += 1
        out.append((keys[at], at, rows[at:end]))
        at = end
    return out


def scan(df: DataFrame, key: str, order: list[str], fold: Fold, emit: str, schema, block_rows: int = 0) -> DataFrame:
    """emit 'each': df with one more column, each row's result (schema: df's and that column);
    'some': the results that are not None; 'last': fold.last(key, state) once a key."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    n = max(1, -(-df.count() // (block_rows or BLOCK_ROWS)))
    blocks = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).checkpoint()

    def told(batches):
        series = _series(pa.Table.from_batches(held), key, fold.columns) if (held := list(batches)) else []
        if series:
            (first, _, rows), (last, _, ends) = series[0], series[-1]
            own = fold.run(fold.fresh(), ends)[0]
            blob = pickle.dumps((first, last, len(series) == 1, fold.summary(rows), own))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([blob], pa.binary())], names=["block", "told"])

    found = {r.block: pickle.loads(r.told) for r in blocks.mapInArrow(told, "block long, told binary").collect()}
    order_of = sorted(found)
    known: dict[int, object] = {}

    def chain() -> tuple[dict, dict, dict]:
        """Start states, those of blocks whose end is not known, and the keys that end in a block."""
        starts, todo, closes, before, state = {}, {}, {}, None, None
        for i, b in enumerate(order_of):
            first, last, one, change, own = found[b]
            goes_on = before is not None and _same(first, before[0])
            if goes_on and state is not _UNKNOWN:
                starts[b] = state
            if one and goes_on:
                end = known.get(b, _UNKNOWN if state is _UNKNOWN else change(state))
                if end is _UNKNOWN or end == _UNKNOWN:
                    if state is not _UNKNOWN:
                        todo[b] = state
                    end = _UNKNOWN
                state = end
            else:
                state = own
            before = (last,)
            closes[b] = i + 1 == len(order_of) or not _same(found[order_of[i + 1]][0], last)
        return starts, todo, closes

    starts, todo, closes = chain()
    while todo:

        def ends(batches, todo=todo):
            b = TaskContext.get().partitionId()
            if b in todo:
                series = _series(pa.Table.from_batches(list(batches)), key, fold.columns)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([pickle.dumps(fold.run(todo[b], series[0][2])[0])], pa.binary())], names=["block", "end"])

        known |= {r.block: pickle.loads(r.end) for r in blocks.mapInArrow(ends, "block long, end binary").collect()}
        starts, todo, closes = chain()

    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names, kinds = [f.name for f in schema.fields], [to_arrow_type(f.dataType) for f in schema.fields]
    shared = spark.sparkContext.broadcast((starts, closes))

    def apply(batches):
        held = list(batches)
        if not held:
            return
        (starts, closes), b = shared.value, TaskContext.get().partitionId()
        table = pa.Table.from_batches(held)
        series, out = _series(table, key, fold.columns), []
        for i, (k, _, rows) in enumerate(series):
            state, results = fold.run(starts[b] if i == 0 and b in starts else fold.fresh(), rows)
            if emit == "last":
                out += [fold.last(k, state)] if i + 1 < len(series) or closes[b] else []
            else:
                out += results if emit == "each" else [(k, *r) for r in results if r is not None]
        if emit == "each":
            done = table.append_column(names[-1], pa.array(out, kinds[-1]))
        elif out:
            done = pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
        else:
            return
        yield from done.to_batches(max_chunksize=10_000)

    return blocks.mapInArrow(apply, schema)


# -------------------------------------------------- functions of the start state


class Clamped:
    """x to min(high, max(low, x + add)): closed under composition."""

    def __init__(self, steps: list[float], low: float, high: float):
        self.low, self.high, self.add = -np.inf, np.inf, 0.0
        for d in steps:
            self.add += d
            self.low, self.high = (min(high, max(low, x + d)) for x in (self.low, self.high))

    def __call__(self, x: float) -> float:
        return min(self.high, max(self.low, x + self.add))


class Pieces:
    """A function of a start amount in (-inf, top]: on each piece the amount plus a shift, or a
    constant. It begins as the identity; grants and refills split and merge pieces."""

    def __init__(self, top: float):
        self.at = np.array([-np.inf])  # where pieces begin
        self.shift, self.fixed = np.zeros(1), np.zeros(1, bool)  # fixed: the shift is the value
        self.top = top
        self.most = top  # upper bound of all values

    def _split(self, value: float) -> np.ndarray:
        """Cuts pieces where they reach a value; tells which lie at or above it."""
        end = np.append(self.at[1:], np.inf)
        x = value - self.shift
        cut = np.flatnonzero(~self.fixed & (self.at < x) & (x < end) & (x <= self.top))
        if len(cut):
            points = x[cut]
            self.at = np.insert(self.at, cut + 1, points)
            self.shift, self.fixed = (np.insert(v, cut + 1, v[cut]) for v in (self.shift, self.fixed))
        return np.where(self.fixed, self.shift >= value, self.at >= value - self.shift)

    def _merge(self) -> None:
        same = (self.shift[1:] == self.shift[:-1]) & (self.fixed[1:] == self.fixed[:-1])
        if same.any():
            keep = np.append(True, ~same)
            self.at, self.shift, self.fixed = self.at[keep], self.shift[keep], self.fixed[keep]

    def refill(self, amount: float, cap: float) -> None:
        self.shift = self.shift + amount
        self.most += amount
        if self.most > cap:
            above = self._split(cap)
            self.shift, self.fixed = np.where(above, cap, self.shift), self.fixed | above
            self.most = cap
            self._merge()

    def grant(self, amount: float, least: float) -> None:
        """Takes the amount wherever that much and no less than least is left."""
        if self.most - amount < least:
            return
        able = self._split(amount + least)
        self.shift = np.where(able, self.shift - amount, self.shift)
        if able.all():
            self.most -= amount
        elif len(self.at) > 1:
            end = np.append(self.at[1:], self.top)
            self.most = min(self.most, float(np.where(self.fixed, self.shift, end + self.shift).max()))
        self._merge()

    def __call__(self, x: float) -> float:
        i = int(np.searchsorted(self.at, x, "right")) - 1
        return float(self.shift[i] if self.fixed[i] else x + self.shift[i])


# ------------------------------------------------------------------------- folds


class Link(Fold):
    """Recovery is fast, a timeout weighs little. state: rtt, jitter, loss, good probes in a row."""

    def __init__(self, rtt_weight: float, decay: float, recover: float):
        self.columns, self.w, self.decay, self.recover = ["rtt", "ok"], rtt_weight, decay, recover

    def fresh(self):
        return 0.0, 0.0, 0.0, 0

    def step(self, state, row):
        (rtt, jitter, loss, good), (r, ok) = state, row
        if not ok:
            return (rtt, jitter, self.decay + (1 - self.decay) * loss, 0), None
        good = min(2, good + 1)
        loss *= 1 - self.recover
        now = self.w * r + (1 - self.w) * (rtt or r)
        return (now, self.w * abs(r - rtt) + (1 - self.w) * jitter, min(loss, 0.05) if good >= 2 else loss, good), None

    def summary(self, rows):
        """Two starts approach each other by a factor a row: after enough of them the end does not
        depend on the start any more (below the rounding of a double)."""
        w, worst = 1 - self.w, max(1 - self.decay, 1 - self.recover)
        n, ok = len(rows), sum(1 for r in rows if r[1])
        if ok and ok * w ** (ok / 2) < 1e-25 and worst**n < 1e-25:
            return Constant(self.run((1.0, 0.0, 0.5, 0), rows)[0])
        return Constant(_UNKNOWN)

    def last(self, key, state):
        return key, round(state[0], 4), round(state[1], 4), round(state[2], 6)


class Constant:
    def __init__(self, end):
        self.end = end

    def __call__(self, _):
        return self.end


class Ladder(Fold):
    """A level up while the budget burns too fast, one down when it does not, never before a level
    has lasted its dwell. state: level, since."""

    def __init__(self, t: str, burn: str, up: float, down: float, dwell: float, top: int):
        self.columns, self.up, self.down, self.dwell, self.top = [t, burn], up, down, dwell, top

    def fresh(self):
        return 0, None

    def _to(self, level: int, burn: float) -> int:
        return min(self.top, level + 1) if burn >= self.up else max(0, level - 1) if burn <= self.down else level

    def step(self, state, row):
        (level, since), (t, burn) = state, row
        since = t if since is None else since
        if t - since < self.dwell or (to := self._to(level, burn)) == level:
            return (level, since), None
        return (to, t), (t, to)

    def summary(self, rows):
        return LadderMap(self, rows)


class LadderMap:
    """Exact for every start: a change is the first row, after the dwell, whose burn moves the
    level. All changes that can come first lead to ends that are told here; later ones are met by
    jumps from change to change, each computed once."""

    def __init__(self, fold: Ladder, rows: list[tuple]):
        t, burn = (np.array([r[k] for r in rows], float) for k in (0, 1))
        n = len(t)
        self.dwell = fold.dwell
        moves = [np.array([fold._to(level, b) != level for b in burn], bool) for level in range(fold.top + 1)]
        nxt = []
        for m in moves:  # the first row from each on that moves this level
            at = np.where(m, np.arange(n), n)
            nxt.append(np.append(np.minimum.accumulate(at[::-1])[::-1], n))
        # releases[j]: the first row from which a level taken at row j can change
        releases = np.array([_released(t, x, fold.dwell) for x in t]) if n < 64 else _all_released(t, fold.dwell)
        ends: dict[tuple[int, int], tuple] = {}

        def end_of(level: int, j: int) -> tuple:
            """The end of a series whose level becomes `level` at row j."""
            path = []
            while (level, j) not in ends:
                path.append((level, j))
                k = int(nxt[level][releases[j]])
                if k >= n:
                    ends[level, j] = (level, float(t[j]))
                    break
                level, j = fold._to(level, burn[k]), k
            for p in path:
                ends[p] = ends[level, j]
            return ends[level, j]

        head = int(np.searchsorted(t, t[0] + fold.dwell, "right")) + 1
        self.t = t[:head]
        self.next = [x[: min(head, n) + 1] for x in nxt]
        self.n = n
        self.end = {(level, int(k)): end_of(fold._to(level, burn[k]), int(k)) for level in range(fold.top + 1) for k in np.unique(self.next[level]) if k < n}

    def __call__(self, state):
        level, since = state
        if since is None:
            return _UNKNOWN
        k = int(self.next[level][_released(self.t, since, self.dwell)])
        return state if k >= self.n else self.end[level, k]


def _released(t: np.ndarray, since: float, dwell: float) -> int:
    """The first row with t - since >= dwell, as the step computes it."""
    i = max(0, int(np.searchsorted(t, since + dwell)) - 2)
    while i < len(t) and t[i] - since < dwell:
        i += 1
    return i


def _all_released(t: np.ndarray, dwell: float) -> np.ndarray:
    i = np.maximum(np.searchsorted(t, t + dwell) - 2, 0)
    while (late := (i < len(t)) & (t[np.minimum(i, len(t) - 1)] - t < dwell)).any():
        i = i + late
    return i


class Clock(Fold):
    """A clock that merges remote stamps. state: wall, count."""

    columns = ["wall_ms", "counter"]

    def fresh(self):
        return 0, 0

    def step(self, state, row):
        (wall, count), (w, c) = state, row
        count = max(count, c) + 1 if w == wall else c + 1 if w > wall else count + 1
        wall = max(wall, w)
        return (wall, count), f"{wall:013d}.{count:05d}"

    def summary(self, rows):
        return ClockMap(self, rows)


class ClockMap:
    """A later wall than the start's makes the end independent of it; otherwise the count grows by
    one a row, or from a stamp with the same wall."""

    def __init__(self, fold: Clock, rows: list[tuple]):
        self.n, self.wall = len(rows), max(r[0] for r in rows)
        self.own = fold.run((-1, 0), rows)[0]
        self.best = max(c + self.n - j for j, (w, c) in enumerate(rows) if w == self.wall)

    def __call__(self, state):
        wall, count = state
        if self.wall > wall:
            return self.own
        return wall, max(count + self.n, self.best) if self.wall == wall else count + self.n


class TokenBucket(Fold):
    """state: tokens, time of the last request."""

    def __init__(self, t: str, amount: str, rate: float, burst: float, least: float):
        self.columns, self.rate, self.burst, self.least = [t, amount], rate, burst, least

    def fresh(self):
        return self.burst, None

    def step(self, state, row):
        (tokens, last), (t, a) = state, row
        if last is not None:
            tokens = min(self.burst, tokens + max(0.0, t - last) * self.rate)
        ok = tokens - a >= self.least
        return (tokens - a if ok else tokens, t if last is None else max(last, t)), ok

    def summary(self, rows):
        return BucketMap(self, rows)


class BucketMap:
    def __init__(self, fold: TokenBucket, rows: list[tuple]):
        self.first, self.last, self.rate, self.burst = rows[0][0], max(r[0] for r in rows), fold.rate, fold.burst
        self.pieces: Pieces | None = Pieces(fold.burst)
        last = self.first
        for t, a in rows:
            if t > last:
                self.pieces.refill((t - last) * fold.rate, fold.burst)
                last = t
            self.pieces.grant(a, fold.least)
            if len(self.pieces.at) > PIECES:
                self.pieces = None
                break

    def __call__(self, state):
        if self.pieces is None:
            return _UNKNOWN
        tokens, last = state
        return self.pieces(min(self.burst, tokens + max(0.0, self.first - last) * self.rate)), max(last, self.last)


class Budget(Fold):
    """What does not fit is skipped, the first always goes. state: what is left, any sent."""

    columns = ["bytes"]

    def __init__(self, budget: int):
        self.budget = budget

    def fresh(self):
        return self.budget, False

    def step(self, state, row):
        left, any_sent = state
        go = not any_sent or left >= row[0]
        return (left - row[0] if go else left, any_sent or go), go

    def summary(self, rows):
        return BudgetMap(self.budget, rows)


class BudgetMap:
    def __init__(self, budget: int, rows: list[tuple]):
        self.pieces: Pieces | None = Pieces(float(budget))
        for (size,), times in groupby(rows):
            for _ in times:
                self.pieces.grant(size, 0)
            if len(self.pieces.at) > PIECES:
                self.pieces = None
                break

    def __call__(self, state):
        return _UNKNOWN if self.pieces is None else (int(self.pieces(state[0])), True)


class Trust(Fold):
    def __init__(self, delta: str, start: float):
        self.columns, self.start = [delta], start

    def fresh(self):
        return self.start

    def step(self, state, row):
        return max(0.0, min(1.0, state + row[0])), None

    def summary(self, rows):
        return Clamped([r[0] for r in rows], 0.0, 1.0)

    def last(self, key, state):
        return key, state


# -------------------------------------------------------------------- operators


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def link_health(df: DataFrame, key: str, order: str, rtt_weight: float = 0.3, decay: float = 0.25, recover: float = 0.5) -> DataFrame:
    """key, rtt, jitter, loss after all probes (rtt, ok): recovery is fast, a timeout weighs little."""
    return scan(df, key, [order], Link(rtt_weight, decay, recover), "last", f"{key} {dict(df.dtypes)[key]}, rtt double, jitter double, loss double")


def degradation(df: DataFrame, key: str, order: str, burn: str, up: float = 2.0, down: float = 0.5, dwell: float = 8.0, top: int = 4) -> DataFrame:
    """key, t, level at each change: a level up while the budget burns too fast, one down when it
    does not, never before a level has lasted its dwell."""
    return scan(df, key, [order, burn], Ladder(order, burn, up, down, dwell, top), "some", f"{key} {dict(df.dtypes)[key]}, {order} double, level int")


def hybrid_clock(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with stamp, the clock after merging each remote stamp (wall_ms, counter): greater than
    all before."""
    return scan(df, key, [order], Clock(), "each", _with(df, "stamp", T.StringType()))


def adaptive_token_bucket(df: DataFrame, key: str, ts: str, amount: str, rate: float, burst: float, least: float = 0.0, tie: str | None = None) -> DataFrame:
    """df with admitted: ordered requests (by ts, then tie) by a token bucket, one state a key."""
    return scan(df, key, [ts, tie or amount], TokenBucket(ts, amount, rate, burst, least), "each", _with(df, "admitted", T.BooleanType()))


def budget_fill(ordered: DataFrame, key: str, budget: int, tie: str = "op_id") -> DataFrame:
    """df with sent: greedy fill of a byte budget by priority (0 first) within each key; what does
    not fit is skipped, the first always goes."""
    return scan(ordered, key, ["priority", tie], Budget(budget), "each", _with(ordered, "sent", T.BooleanType()))


def trust(df: DataFrame, device: str, order: str, delta: str, start: float = 0.75) -> DataFrame:
    """device, trust: a start value moved by ordered deltas, kept within 0..1 at every step."""
    return scan(df.withColumn(delta, F.col(delta).cast("double")), device, [order], Trust(delta, start), "last", f"{device} {dict(df.dtypes)[device]}, trust double")
