"""Quantised vectors, fitted spaces, learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ann as A
from ..operators import embedding as E
from ..operators import learning as L
from ..operators import quantize as Q
from ..operators import smallworld as S
from ..operators.storage import stored
from .registry import query
from .views import table


def _v(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")


def _stated(v):
    return v.where("id % 50 = 0 and dense is not null").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))


@query(
    """WITH s AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS s FROM embeddings), c AS (SELECT id, v, s, list_transform(v, lambda x: round_even(x / s * 127, 0)) AS c FROM s)
SELECT id, round(s, 6) AS scale, CAST(list_sum(c) AS BIGINT) AS code_sum, CAST(list_sum(list_transform(c, lambda x: abs(x))) AS BIGINT) AS code_abs, round(list_max(list_transform(list_zip(v, c), lambda z: abs(z[1] - z[2] / 127.0 * s))), 6) AS worst FROM c"""
)
def int8_roundtrip(spark, sf):
    s = _v(spark, sf).withColumn("s", V.int8_scale(F.col("dense")))
    c = s.withColumn("c", V.int8_encode(F.col("dense"), F.col("s"))).withColumn("d", V.int8_decode(F.col("c"), F.col("s")))

    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    worst = F.array_max(F.zip_with(V.doubles(F.col("dense")), F.col("d"), lambda x, y: F.abs(x - y)))
    return c.select("id", F.round("s", 6).alias("scale"), total(F.col("c")).alias("code_sum"), total(F.transform("c", F.abs)).alias("code_abs"), F.round(worst, 6).alias("worst"))


@query(
    """WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS b FROM embeddings), s AS (SELECT q.id AS query_id, e.id, round(1 - 2.0 * list_sum(list_transform(list_zip(q.b, e.b), lambda z: CAST(z[1] <> z[2] AS INT))) / 64, 6) AS score FROM b q, b e WHERE q.id % 50 = 0)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def sign_hamming_topk(spark, sf):
    from ..operators.retrieval import nearest, top_k

    # as +1 and -1, the product of n signs is n - 2 * hamming
    b = _v(spark, sf).select("id", F.transform(V.sign_bits(F.col("dense")), lambda x: 2.0 * x - 1).alias("dense"), F.size("dense").alias("n"))
    s = nearest(b, b.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q")), 10)
    return top_k(s.select("query_id", "id", F.round(F.col("score") / F.lit(float(b.first().n)), 6).alias("score")), 10, ["query_id"])


@query("WITH b AS (SELECT sum(4 * len(embedding)) AS hot, sum(len(embedding) + 4) AS warm, sum(CAST(ceil(len(embedding) / 8) AS BIGINT)) AS cold FROM embeddings) SELECT unnest(['hot', 'warm', 'cold']) AS tier, round(unnest([hot / hot, hot / warm, hot / cold]), 4) AS ratio FROM b")
def compression_ratio(spark, sf):
    """Bytes of all vectors as floats against bytes as scaled integers and as signs."""
    n = F.size("dense")
    b = _v(spark, sf).where("dense is not null").agg(F.sum(4 * n).alias("hot"), F.sum(n + 4).alias("warm"), F.sum(F.ceil(n / 8)).alias("cold"))
    return b.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tier"), F.round(F.col("hot") / F.col(t), 4).alias("ratio")) for t in ("hot", "warm", "cold")])))


@query()
def rabitq_bound(spark, sf):
    v = _v(spark, sf)
    c = Q.mean_vector(v, "dense")
    q = np.array(v.where("id = 7").first().dense, float)
    e = Q.one_bit_estimate(Q.one_bit_codes(v, c), q, c)
    return Q.shortlist(e, 10).select("id", F.round("estimate", 4).alias("estimate"), F.round("bound", 4).alias("bound"))


def _model(v, cells):
    """Fit on the 2,000 vectors with the smallest hashes."""
    sample = np.array([r.dense for r in v.where("dense is not null").orderBy(F.xxhash64("id"), "id").limit(2000).collect()], float)
    return Q.IvfPq(sample, cells=cells or max(4, min(256, int(len(sample) ** 0.5))))


def _indexed(spark, sf, cells):
    """(vectors, model, stored index, probes and rescore measured on other rows than are asked)."""
    v = _v(spark, sf)
    m = _model(v, cells)
    index = stored(spark, f"ivf-{cells}", [f"{sf}/embeddings.parquet"], None, write=lambda path: A.write_index(v, m, path, mode="overwrite"))
    others = v.where("id % 50 = 25 and dense is not null").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
    return m, index, Q.calibrate(v, m, others, 10, target=0.98)


@query()
def pq_topk(spark, sf):
    """All codes of one cell, the best by code scored exactly."""
    m, index, c = _indexed(spark, sf, 1)
    return A.search(index, m, _stated(_v(spark, sf)), 10, 1, c["rescore"]).withColumn("score", F.round("score", 6))


@query()
def ivfpq_topk(spark, sf):
    m, index, c = _indexed(spark, sf, None)
    return A.search(index, m, _stated(_v(spark, sf)), 10, c["probes"], c["rescore"]).withColumn("score", F.round("score", 6))


@query()
def graph_topk(spark, sf):
    """The stated vectors' neighbours by a small-world graph a shard."""
    v = _v(spark, sf)
    graph = stored(spark, "small-world", [f"{sf}/embeddings.parquet"], lambda: S.build(v, S.shards(v)))
    return S.search(graph, _stated(v), 10).withColumn("score", F.round("score", 6))


_NEAREST = """SELECT a.vec_id % s AS shard, a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN (SELECT greatest(1, CAST(ceil(count(*) / 4096.0) AS BIGINT)) AS s FROM embeddings) n ON TRUE JOIN embeddings b ON b.vec_id % s = a.vec_id % s AND b.vec_id <> a.vec_id
 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) <= 6"""


@query(
    f"""WITH e AS MATERIALIZED ({_NEAREST}), r AS (SELECT * FROM e WHERE src % 50 = 0 AND dst % 50 <> 0),
p AS (SELECT DISTINCT a.shard, a.dst AS src, b.dst AS dst FROM r a JOIN r b ON a.src = b.src AND a.dst <> b.dst), f AS (SELECT p.* FROM p ANTI JOIN e ON e.src = p.src AND e.dst = p.dst)
SELECT f.shard, CAST(0 AS INT) AS layer, f.src, f.dst FROM f LEFT JOIN (SELECT src, count(*) AS held FROM e GROUP BY src) h ON h.src = f.src QUALIFY row_number() OVER (PARTITION BY f.src ORDER BY f.dst) + coalesce(held, 0) <= 8"""
)
def graph_crosslinks(spark, sf):
    """The links that removing the stated vectors adds to the graph of six nearest ones."""
    v = _v(spark, sf)
    graph = stored(spark, "nearest-six", [f"{sf}/embeddings.parquet"], lambda: S.build(v, S.shards(v), degree=6, spread=False))
    return S.crosslinks(graph, v.where("id % 50 = 0"), most=8)


@query()
def whitened_topk(spark, sf):
    v = _v(spark, sf)
    m = Q.Whitening(*Q.second_moments(v))
    w = Q.whiten(v, m)
    q = w.where("id = 7").first().white
    return w.select("id", F.round(V.dot(F.array(*[F.lit(float(x)) for x in q]), F.col("white")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query()
def space_report(spark, sf):
    m = Q.Whitening(*Q.second_moments(_v(spark, sf)))
    a = Q.anisotropy(m.values, m.mean)
    rows = [(d, e, b, float(r), str(a["verdict"])) for d, e, b, r in m.ladder([8, 16, 32, 64])]
    return spark.createDataFrame(rows, "dims int, energy double, bytes int, ratio double, verdict string")


@query(
    """WITH m AS (SELECT p, avg(x) AS m FROM (SELECT unnest(range(1, 65)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY p) SELECT round(sqrt(sum(m * m)), 8) AS drift FROM m"""
)
def centroid_drift(spark, sf):
    m = Q.mean_vector(_v(spark, sf), "dense")
    return spark.createDataFrame([(round(float(np.sqrt((m * m).sum())), 8),)], "drift double")


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 0.5 / greatest(0.5, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS norm FROM embeddings")
def clip_norm(spark, sf):
    return _v(spark, sf).select("id", F.round(V.norm(V.clip_norm(F.col("dense"), 0.5)), 6).alias("norm"))


@query("SELECT CAST(p - 1 AS INT) AS pos, round(avg(x), 6) AS value FROM (SELECT unnest(range(1, 65)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY p")
def federated_mean(spark, sf):
    c = _v(spark, sf).select(F.col("id").cast("string").alias("node"), F.col("dense").alias("vec"))
    return L.federated_mean(c, 0).withColumn("value", F.round("value", 6))


@query("SELECT label, 0.5 + 0.25 * label AS sigma, CAST(count(*) AS INTEGER) AS parameters, CAST(ceil((0.5 + 0.25 * label) * (0.5 + 0.25 * label) * count(*)) AS BIGINT) AS cohort FROM embeddings GROUP BY label")
def required_cohort(spark, sf):
    d = _v(spark, sf).groupBy("label").agg(F.count("*").cast("int").alias("parameters")).withColumn("sigma", F.lit(0.5).cast("double") + F.lit(0.25).cast("double") * F.col("label"))
    return d.select("label", "sigma", "parameters", L.required_cohort(F.col("sigma"), F.col("parameters")).alias("cohort"))


@query("SELECT label, round(sqrt(2 * ln(1.25 / 1e-5)) * max(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)))) / (0.5 + label), 5) AS sigma FROM embeddings GROUP BY label")
def gaussian_sigma(spark, sf):
    """Each label's largest component as the sensitivity, its number as the budget."""
    most = F.array_max(F.transform("dense", F.abs)).cast("double")
    return _v(spark, sf).groupBy("label").agg(F.max(most).alias("m")).select("label", F.round(L.sigma_of(F.lit(0.5) + F.col("label"), 1e-5, F.col("m")), 5).alias("sigma"))


_WORDS = """WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), c AS MATERIALIZED (SELECT id, token, count(*) AS n FROM t GROUP BY id, token),
w AS MATERIALIZED (SELECT token, CAST(concat('0x', substr(md5(token), 1, 6)) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT DISTINCT token FROM c)),
e AS MATERIALIZED (SELECT id, w.vec_id, sum(n) AS n FROM c JOIN w ON w.token = c.token GROUP BY id, w.vec_id),
v AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"""


def _token_table(spark, sf):
    """Every token of the documents with one of the embeddings."""
    v = _v(spark, sf)
    at = F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("long") % v.count()
    words = E.tokens(table(spark, sf, "documents"), "doc_id").select("token").distinct()
    return words.withColumn("id", at).join(v.select("id", F.col("dense").alias("vec")), "id").select("token", "vec")


@query(f"""{_WORDS}, m AS (SELECT id, i, sum(n * x) / sum(n) AS x, CAST(sum(n) AS BIGINT) AS n FROM e JOIN v ON v.vec_id = e.vec_id GROUP BY id, i), r AS (SELECT id, max(n) AS n, max(x) FILTER (WHERE i = 1) / sqrt(sum(x * x)) AS a, max(x) FILTER (WHERE i = 64) / sqrt(sum(x * x)) AS b FROM m GROUP BY id)
SELECT d.doc_id AS id, coalesce(n, 0) AS n, round(a, 5) AS first, round(b, 5) AS last FROM documents d LEFT JOIN r ON r.id = d.doc_id""")
def text_embeddings(spark, sf):
    e = E.encode(table(spark, sf, "documents"), _token_table(spark, sf), 64, "doc_id")
    return e.select("id", "n", F.round(F.get("vec", F.lit(0)), 5).alias("first"), F.round(F.get("vec", F.lit(63)), 5).alias("last"))


@query(f"{_WORDS} SELECT id, CAST(sum(n) AS BIGINT) AS n, round(sum(n * x), 4) AS total FROM e JOIN v ON v.vec_id = e.vec_id AND i = 1 GROUP BY id")
def token_embeddings(spark, sf):
    t = E.token_vectors(table(spark, sf, "documents"), _token_table(spark, sf), "doc_id")
    return t.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.get("vec", F.lit(0)).cast("double")), 4).alias("total"))


@query()
def prune_late(spark, sf):
    t = _v(spark, sf).select(F.col("label").alias("id"), F.col("id").alias("pos"), F.col("dense").alias("vec"))
    return Q.prune_late(t, 8).select("id", "pos")


@query()
def adapter_rescore(spark, sf):
    v = _v(spark, sf)
    q = np.array(v.where("id = 7").first().dense, float)
    rows = [np.array(r.dense, float) for r in v.where("id in (1, 2)").orderBy("id").collect()]
    a = L.Adapter(len(q))
    a.learn([(q, rows[0], rows[1], 1.0)])
    base = v.withColumn("score", V.dot(F.array(*[F.lit(float(x)) for x in q]), F.col("dense")))
    return a.rescore(base, q).orderBy(F.desc("adapted"), "id").limit(10).select("id", F.round("adapted", 6).alias("adapted"))


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def rotated_norm(spark, sf):
    """A rotation leaves norms as they are."""
    v = _v(spark, sf)
    r = Q.Rotation(v.selectExpr("size(dense) AS n").first().n)

    def turn(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(norm=np.linalg.norm(r.apply(np.stack(pdf["dense"].to_numpy()).astype(float)), axis=1).round(5))[["id", "norm"]]

    return v.select("id", "dense").mapInPandas(turn, "id long, norm double")


@query("SELECT CAST(p - 1 AS INT) AS pos, round(sum(x), 4) AS value FROM (SELECT unnest(range(1, 65)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings WHERE vec_id IN (SELECT n_nationkey FROM nation)) GROUP BY p")
def masked_sum(spark, sf):
    """One contribution of each nation."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("node"))
    cohort = [r.node for r in n.select("node").distinct().collect()]
    c = _v(spark, sf).join(F.broadcast(n), "id").select("node", F.col("dense").alias("vec"))
    return L.masked_sum(c, cohort, 4).withColumn("value", F.round("value", 4))


@query()
def noisy_mean(spark, sf):
    p = L.privatize(_v(spark, sf).select("id", "dense"), "dense", 1.0, 8.0, 1e-5, 7)
    at = p.select(F.posexplode("dense").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("value"))
    return at.select("pos", F.round("value", 3).alias("value"))


@query()
def pca_projection(spark, sf):
    v = _v(spark, sf)
    p = Q.Projection(*Q.second_moments(v))
    x, y = p.project(F.col("dense"))
    return v.select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y")).withColumn("explained", F.lit(round(sum(p.explained), 4)))


_HALF = "CAST({0}.embedding[1:32] AS DOUBLE[])"


@query(
    f"""WITH d AS (SELECT q.vec_id AS q, e.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS a, round(list_dot_product({_HALF.format('q')}, {_HALF.format('e')}), 6) AS b FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
x AS (SELECT q, id FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY a DESC, id) <= 5), y AS (SELECT q, id FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY b DESC, id) <= 5),
r AS (SELECT round((SELECT count(*) FROM x JOIN y USING (q, id)) / CAST((SELECT count(*) FROM x) AS DOUBLE), 6) AS recall) SELECT recall, CASE WHEN 1.0 - recall > 0.08 THEN 'blocked' ELSE 'finished' END AS verdict FROM r"""
)
def migration_gate(spark, sf):
    """A smaller space against the one in use: recall of the five nearest over the golden set."""
    from ..operators.retrieval import nearest, top_k

    v = _v(spark, sf)

    def five(rows):
        q = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
        return top_k(nearest(rows, q, 5).withColumn("score", F.round("score", 6)), 5, ["query_id"]).select("query_id", "id")

    golden, found = five(v), five(v.withColumn("dense", F.slice("dense", 1, 32)))
    n = golden.agg(F.count("*").alias("n"))
    return golden.join(found, ["query_id", "id"]).agg(F.count("*").alias("hit")).join(n).select(F.round(F.col("hit") / F.col("n"), 6).alias("recall")).withColumn("verdict", F.when(1.0 - F.col("recall") > 0.08, "blocked").otherwise("finished"))


@query()
def ivfpq_calibrated(spark, sf):
    """What the index search uses."""
    _, _, c = _indexed(spark, sf, None)
    return spark.createDataFrame([(c["probes"], c["rescore"])], "probes int, rescore int")


@query()
def self_evaluate(spark, sf):
    """Whether whitening pays: reciprocal ranks of each stated vector's next one, both spaces."""
    from ..operators.retrieval import nearest, reciprocal_ranks, top_k

    v = _v(spark, sf).where("dense is not null")
    w = Q.whiten(v, Q.Whitening(*Q.second_moments(v))).withColumn("dense", F.col("white"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"))
    truth = q.join(v.select("id"), F.col("id") == F.col("query_id") + 1)

    def ranks(rows):
        asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
        return reciprocal_ranks(top_k(nearest(rows, asked, 10, others=True), 10, ["query_id"]), truth)

    both = ranks(v).join(ranks(w).withColumnRenamed("rr", "white"), "query_id").orderBy("query_id").select("rr", "white").toPandas()
    mean, low, high = L.paired_bootstrap(both["rr"].to_numpy(float), both["white"].to_numpy(float)) if len(both) else (0.0, 0.0, 0.0)
    return spark.createDataFrame([(len(both), round(mean, 6), round(low, 6), round(high, 6), L.adopt({"white": (mean, low, high)}) or "none")], "probes int, gain double, low double, high double, adopted string")
