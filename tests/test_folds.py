"""Ordered folds as scans over blocks against the same steps one by one."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import folds


def cut(rng, rows, k):
    at = sorted(rng.sample(range(1, len(rows)), k))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


def stamps(rng, n):
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([0, 0, 1, 2])
        out.append((t + (50 if rng.random() < 0.02 else rng.choice([0, 0, -3])), rng.randrange(5)))
    return out


def burns(rng, n):
    t, out = 0.0, []
    for _ in range(n):
        t += rng.choice([0, 0.1, 1, 5, 0.30000001])
        out.append((t, rng.choice([0.1, 0.5, 1.0, 1.5, 2.0, 3.0])))
    return out


def requests(rng, n, amounts=(1.0, 2.0, 3.0), gaps=(0, 100, 700, 2000)):
    t, out = 0.0, []
    for _ in range(n):
        t += rng.choice(gaps) * rng.random()
        out.append((t, rng.choice(amounts) if amounts else rng.uniform(0.2, 4)))
    return out


CASES = {
    "trust": (folds.Trust("d", 0.75), lambda r: [(r.choice([0.01, -0.05, 0.3, -0.4]),) for _ in range(300)]),
    "clock": (folds.Clock(), lambda r: stamps(r, 300)),
    "ladder": (folds.Ladder("t", "b", 2.0, 0.5, 8.0, 4), lambda r: burns(r, 300)),
    "bucket": (folds.TokenBucket("t", "a", 0.001, 5.0, 0.0), lambda r: requests(r, 300)),
    "bucket, floor": (folds.TokenBucket("t", "a", 0.001, 5.0, 0.5), lambda r: requests(r, 300, None)),
    "bucket, starved": (folds.TokenBucket("t", "a", 0.001, 50.0, 0.0), lambda r: requests(r, 300, None, (0, 100, 300))),
    "budget": (folds.Budget(32768), lambda r: [(r.randint(80, 200),) for _ in range(300)]),
    "budget, large rows": (folds.Budget(3000), lambda r: [(r.randint(1, 900),) for _ in range(300)]),
    "link": (folds.Link(0.3, 0.25, 0.5), lambda r: [(r.uniform(1, 100), r.random() > 0.1) for _ in range(3000)]),
}


@pytest.mark.parametrize("name", CASES)
def test_block_functions(name):
    """A block's function of its start state gives what its rows give one by one."""
    fold, make = CASES[name]
    rng, known = random.Random(name), 0
    for _ in range(40):
        first, *rest = cut(rng, make(rng), 5)
        state = fold.run(fold.fresh(), first)[0]
        for rows in rest:
            told, state = fold.summary(rows)(state), fold.run(state, rows)[0]
            if told != folds._UNKNOWN:
                known += 1
                pairs = zip(told, state) if isinstance(state, tuple) else [(told, state)]
                assert all(a == b or abs(a - b) < 1e-9 for a, b in pairs)
    assert known > 80


def plain(fold, rows):
    """rows: (key, order, values): results by (key, order), and end states."""
    out, ends = {}, {}
    for k in {r[0] for r in rows}:
        state = fold.fresh()
        for _, o, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            state, out[k, o] = fold.step(state, v)
        ends[k] = state
    return out, ends


def keys(rng, n):
    """One key with most rows, a null key, small ones."""
    return [rng.choice([1, 1, 1, 1, 1, None, 2, 3]) for _ in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(folds, "BLOCK_ROWS", 150)


def test_scans_over_many_blocks(spark, small_blocks):
    rng, n = random.Random(3), 1500
    own = keys(rng, n)
    req, clock, size, delta = requests(rng, n), stamps(rng, n), [rng.randint(50, 3000) for _ in range(n)], [rng.choice([0.01, -0.05, 0.2, -0.3]) for _ in range(n)]
    burn = [b for _, b in burns(rng, n)]
    probe = [(rng.uniform(1, 90), rng.random() > 0.15) for _ in range(n)]
    rows = [(own[i], i, req[i][0], req[i][1], *clock[i], size[i], delta[i], burn[i], *probe[i], "x") for i in range(n)]
    df = spark.createDataFrame(rows, "k int, op_id long, t double, amount double, wall_ms long, counter int, bytes int, delta double, burn double, rtt double, ok boolean, block string").repartition(5)
    series = lambda *cols: [(own[i], i, tuple(rows[i][c] for c in cols)) for i in range(n)]

    got = folds.adaptive_token_bucket(df, "k", "t", "amount", 0.001, 5.0, tie="op_id")
    assert got.columns == [*df.columns, "admitted"]
    assert {(r.k, r.op_id): r.admitted for r in got.collect()} == plain(folds.TokenBucket("t", "a", 0.001, 5.0, 0.0), series(2, 3))[0]
    got = folds.hybrid_clock(df, "k", "op_id")
    assert {(r.k, r.op_id): r.stamp for r in got.collect()} == plain(folds.Clock(), series(4, 5))[0]
    got = folds.budget_fill(df.withColumn("priority", F.lit(0)), "k", 32 * 1024)
    assert {(r.k, r.op_id): r.sent for r in got.collect()} == plain(folds.Budget(32 * 1024), series(6))[0]
    got = {r.k: r.trust for r in folds.trust(df, "k", "op_id", "delta").collect()}
    want = plain(folds.Trust("delta", 0.75), series(7))[1]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    got = sorted((str(r.k), r.t, r.level) for r in folds.degradation(df.withColumn("t", F.col("op_id") * 7.0), "k", "t", "burn", dwell=20.0).collect())
    steps = plain(folds.Ladder("t", "burn", 2.0, 0.5, 20.0, 4), [(own[i], i, (i * 7.0, rows[i][8])) for i in range(n)])[0]
    assert got == sorted((str(k), *v) for (k, _), v in steps.items() if v) and len(got) > 20
    link = folds.Link(0.3, 0.25, 0.5)
    want = plain(link, series(9, 10))[1]
    assert {r.k: tuple(r) for r in folds.link_health(df, "k", "op_id").collect()} == {k: link.last(k, s) for k, s in want.items()}


def test_blocks_without_an_answer(spark, small_blocks, monkeypatch):
    """Blocks whose function has too many pieces are run from their true start."""
    rng = random.Random(5)
    rows = [(1, i, *r) for i, r in enumerate(requests(rng, 900, None, (0, 100, 300)))]
    df = spark.createDataFrame(rows, "k int, op_id long, t double, amount double")
    monkeypatch.setattr(folds.TokenBucket, "summary", lambda self, rows: folds.Constant(folds._UNKNOWN))
    got = folds.adaptive_token_bucket(df, "k", "t", "amount", 0.001, 50.0, tie="op_id")
    assert {r.op_id: r.admitted for r in got.collect()} == {o: v for (_, o), v in plain(folds.TokenBucket("t", "a", 0.001, 50.0, 0.0), [(1, i, (t, a)) for _, i, t, a in rows])[0].items()}


def test_empty_fold(spark):
    df = spark.createDataFrame([], "k int, op_id long, delta double")
    assert folds.trust(df, "k", "op_id", "delta").count() == 0


def test_one_key_on_all_cores(spark):
    """One key with two million rows: many tasks take part, none holds more than some blocks' rows."""
    df = spark.range(2_000_000).select(F.lit(1).alias("k"), F.col("id").alias("op_id"), (F.col("id") % 1000).alias("priority"), (F.lit(80) + F.col("id") % 121).cast("int").alias("bytes"))
    out = folds.budget_fill(df, "k", 1 << 20).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.count_if("sent").alias("sent"), F.sum(F.when(F.col("sent"), F.col("bytes"))).alias("b")).collect()
    assert len(out) >= 18 and max(r.n for r in out) < 3 * folds.BLOCK_ROWS
    assert sum(r.n for r in out) == 2_000_000 and (1 << 20) - 80 < sum(r.b or 0 for r in out) <= 1 << 20
