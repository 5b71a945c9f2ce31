"""Streams of operations: latest-wins sinks, windowed quotas, causal delivery, event replay."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import budget_fill
from ..operators.storage import latest


def lww_sink(path: str, key: str = "point_id"):
    """A foreachBatch function that keeps the latest row of each key under path/<batch>, where
    order columns are wall_ms, counter and device_id. Replaying a batch writes the same rows,
    so the sink is idempotent; a reader takes the greatest batch."""
    order = [F.col(c) for c in ("wall_ms", "counter", "device_id")]

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in generations(spark, path) if n < number]
        rows = batch
        if before:
            rows = spark.read.parquet(f"{path}/batch={max(before)}").select(batch.columns).unionByName(batch)
        latest(rows, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def generations(spark, path: str) -> list[int]:
    """Numbers of the batches under a path, in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def head(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={max(generations(spark, path))}")


def push_sink(path: str, send, budget: int, key: str = "op_id"):
    """A foreachBatch function that pushes operations (op_id, device_id, bytes, priority) over a
    link: what earlier batches could not send comes first by priority, the plan fills a byte
    budget a batch and device, send(plan) returns the operations the other side has taken (its
    op_id column), and all others wait under path/<batch>. Replaying a batch starts from the same
    queue, so an operation may be sent twice but none is lost."""

    def push(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in generations(spark, path) if n < number]
        rows = batch.select(key, "device_id", "bytes", "priority")
        if before:
            last = spark.read.parquet(f"{path}/batch={max(before)}")
            rows = rows.unionByName(last.where("not acked").select(rows.columns))
        rows = rows.dropDuplicates([key])
        plan = budget_fill(rows, "device_id", budget, key)
        taken = send(plan.where("sent").drop("sent")).select(key).distinct().withColumn("acked", F.lit(True))
        plan.join(taken, key, "left").withColumn("acked", F.coalesce("acked", F.lit(False))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return push


def acknowledged(spark, path: str) -> DataFrame:
    """All operations that batches of push_sink() have got acknowledged."""
    return spark.read.parquet(path).where("acked")


def channel_sink(path: str, channels: list[str], column: str = "channel"):
    """A foreachBatch function that writes the events of some channels, a folder for each; a
    replayed batch overwrites its own rows only."""

    def emit(batch: DataFrame, number: int) -> None:
        for c in channels:
            batch.where(F.col(column) == c).write.mode("overwrite").parquet(f"{path}/{c}/batch={number}")

    return emit


def write_quota(events: DataFrame, key: str = "user_id", ts: str = "ts", window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in tumbling windows of event time; rows later than late are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def dedup_stream(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: at-least-once delivery becomes effectively once."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


class CausalBuffer(StatefulProcessor):
    """Keeps for a stream how many operations of each sender are out, and those held, each in the
    slot (sender, number) of a cause it waits for. A delivery wakes its slot only. Slots leave the
    state after hold_ms without a change, and what lies in one longer than hold_ms is not woken."""

    def __init__(self, stream: str, hold_ms: int):
        self.stream, self.hold_ms = stream, hold_ms

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "sender string", "n int")
        self.held = handle.getMapState("held", "sender string, n int", "ops string", ttlDurationMs=self.hold_ms)
        self.count = handle.getValueState("count", "n int")

    def _cause(self, sender: str, clock: dict[str, int], seen: dict[str, int]):
        """A slot that has to be out before the operation, or None."""
        own = [(sender, clock[sender] - 1)]
        for k, v in own + [x for x in clock.items() if x[0] != sender]:
            if k not in seen:
                seen[k] = self.seen.getValue((k,))[0] if self.seen.containsKey((k,)) else 0
            if v > seen[k]:
                return k, v
        return None

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        count = self.count.get()[0] if self.count.exists() else 0
        seen: dict[str, int] = {}
        out = []
        for pdf in rows:
            for r in pdf.sort_values(["arrival", "op_id"]).itertuples():
                clock = {k: v for k, v in (json.loads(r.clock) if r.clock else {}).items() if v > 0}
                if r.sender is None or r.sender not in clock:
                    continue
                todo, free = [(int(r.arrival), int(r.op_id), r.sender, clock, now + self.hold_ms)], []
                while todo:
                    item = todo.pop()
                    _, _, sender, clock, until = item
                    slot = self._cause(sender, clock, seen)
                    if slot is not None:
                        before = json.loads(self.held.getValue(slot)[0]) if self.held.containsKey(slot) else []
                        self.held.updateValue(slot, (json.dumps([x for x in before if x[4] > now] + [item]),))
                    elif clock[sender] == seen[sender] + 1:
                        seen[sender] = clock[sender]
                        self.seen.updateValue((sender,), (clock[sender],))
                        free.append(item)
                        slot = (sender, clock[sender])
                        if self.held.containsKey(slot):
                            todo += [x for x in json.loads(self.held.getValue(slot)[0]) if x[4] > now]
                            self.held.removeKey(slot)
                for arrival, op, *_ in sorted(free, key=lambda x: (sum(x[3].values()), x[0], x[1])):
                    count += 1
                    out.append((key[0], op, count))
        self.count.update((count,))
        if out:
            yield pd.DataFrame(out, columns=[self.stream, "op_id", "delivered"])

    def close(self) -> None:
        pass


def causal_delivery(ops: DataFrame, stream: str = "stream", hold_ms: int = 60_000) -> DataFrame:
    """stream, op_id, delivered of operations (clock as JSON text, sender, arrival) in causal order,
    as oplog.causal_release() gives them for clocks that name all that is before them; what waits
    longer than hold_ms of processing time is let go. Operations without a place (null sender or
    clock) and repeated ones are not delivered. The session needs the RocksDB state store; a query
    in processing time runs until it is stopped, so a trigger of availableNow does not end it."""
    kind = dict(ops.dtypes)[stream]
    return ops.groupBy(stream).transformWithStateInPandas(CausalBuffer(stream, hold_ms), f"{stream} {kind}, op_id long, delivered int", "Append", "ProcessingTime")


def token_bucket(requests: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """key, id, admitted of requests (id, t seconds, amount) by a bucket kept across batches."""

    def step(k, batches, state: GroupState):
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("t")
        for r in rows.itertuples():
            tokens = tokens if last is None else min(burst, tokens + max(0.0, r.t - last) * rate)
            last = r.t if last is None else max(last, r.t)
            ok = tokens >= r.amount
            tokens -= r.amount if ok else 0.0
            out.append((k[0], int(r.id), ok))
        state.update((float(tokens), float(last)))
        yield pd.DataFrame(out, columns=[key, "id", "admitted"])

    kind = dict(requests.dtypes)[key]
    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, id long, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
