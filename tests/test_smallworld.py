"""Small-world graphs: recall, diverse links, removal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import smallworld as S


def vectors(kind, n, dims, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n // 100, dims))[rng.integers(0, n // 100, n)] + 0.3 * rng.normal(size=(n, dims)) if kind == "clustered" else rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, dense array<double>")


@pytest.mark.parametrize("kind, n, dims", [("clustered", 3000, 32), ("uniform", 3000, 64)])
def test_recall(spark, kind, n, dims):
    v = vectors(kind, n, dims)
    df = table(spark, v)
    graph = S.build(df, 3).cache()
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
    got = {(r.query_id, r.id) for r in S.search(graph, q, 10).collect()}
    want = {(int(i), int(j)) for i in range(0, n, 50) for j in np.argsort(-(v @ v[i]), kind="stable")[:10]}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    most = graph.where("dst is not null").groupBy("layer", "src").count().agg(F.max("count")).first()[0]
    assert most <= 2 * S.DEGREE and graph.where("dst is null").count() == n
    assert graph.where("layer > 0 and dst is not null").count() > 0
    # removed ones are no answers, the rest is still found
    gone = df.where("id % 3 = 0").select("id")
    left = S.remove(graph, gone)
    got = {(r.query_id, r.id) for r in S.search(left, q, 10).collect()}
    live = np.flatnonzero(np.arange(n) % 3 != 0)
    want = {(int(i), int(j)) for i in range(0, n, 50) for j in live[np.argsort(-(v[live] @ v[i]), kind="stable")[:10]]}
    assert all(j % 3 for _, j in got) and len(got & want) >= 0.9 * len(want)
    graph.unpersist()


def test_diverse_choice():
    """A candidate that is more like a chosen one than like the node waits for free places."""
    sims = np.array([0.9, 0.89, 0.5, 0.4])
    between = np.array([[1, 0.99, 0.1, 0.2], [0.99, 1, 0.1, 0.2], [0.1, 0.1, 1, 0.6], [0.2, 0.2, 0.6, 1]])
    assert S.diverse(sims, between, 2) == [0, 2]
    assert S.diverse(sims, between, 3) == [0, 2, 1]
    assert S.diverse(sims, between, 9) == [0, 2, 1, 3]


def test_small_graphs(spark):
    df = table(spark, vectors("uniform", 200, 8)).limit(1)
    q = df.select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
    assert [r.id for r in S.search(S.build(df, 1), q, 5).collect()] == [r.query_id for r in q.collect()]
    none = df.where("id < 0")
    assert S.search(S.build(none, 1), q, 5).count() == 0
    assert S.search(S.build(df, 1), q.where("query_id < 0"), 5).count() == 0
