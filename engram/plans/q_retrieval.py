"""Lexical and dense retrieval, fusion, scoring, calibration, text understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators.storage import spread, stored
from .registry import query
from .views import notes, NOW, points, table

_STOP = "(" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_TOK = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN " + _STOP + " AND length(x) > 1)"
_TERMS = f"""kept AS (SELECT doc_id AS id, {_TOK} AS k FROM documents),
terms AS (SELECT id, list_concat(k, list_transform(list_zip(k[1:len(k)-1], k[2:]), lambda z: concat(z[1], '_', z[2]))) AS t FROM kept),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(len(t)) FROM terms) AS total),
w AS (SELECT id, tf.term, round(ln(1.0 + (docs - df + 0.5) / (df + 0.5)) * (tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / greatest(total / docs, 1.0))), 6) AS weight FROM tf JOIN dfs ON tf.term = dfs.term, n),
bm AS (SELECT id, term, weight FROM w WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 64)"""


def _texts(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def term_table(spark, sf):
    """Term frequencies of the documents, stored once for all lexical queries of an application."""
    return stored(spark, "terms", [f"{sf}/documents.parquet"], lambda: R.term_frequencies(_texts(spark, sf)))


def index_table(spark, sf):
    """The lexical index of the documents, stored as well."""
    return stored(spark, "index", [f"{sf}/documents.parquet"], lambda: R.bm25(_texts(spark, sf)))


@query(f"WITH {_TERMS} SELECT (SELECT count(*) FROM documents) AS docs, CAST((SELECT sum(len(t)) FROM terms) AS BIGINT) AS total_len, (SELECT count(*) FROM dfs) AS vocabulary, CAST((SELECT sum(df) FROM dfs) AS BIGINT) AS postings")
def bm25_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    tf = term_table(spark, sf)
    v = R.document_frequencies(tf).agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings"))
    return R.corpus_stats(tf, d).join(v)


@query(f"WITH {_TERMS} SELECT id, count(*) AS kept, round(sum(weight), 3) AS total FROM bm GROUP BY id")
def bm25_encode(spark, sf):
    return index_table(spark, sf).groupBy("id").agg(F.count("*").alias("kept"), F.round(F.sum("weight"), 3).alias("total"))


@query()
def term_collisions(spark, sf):
    return R.slot_collisions(term_table(spark, sf))


@query()
def hashed_vectors(spark, sf):
    """The lexical index by slots: entries, and what terms have in all, of each document."""
    h = R.hashed(index_table(spark, sf))
    return h.groupBy("id").agg(F.count("*").alias("slots"), F.round(F.sum("weight"), 3).alias("total"))


_SPARSE_SQL = f"""WITH {_TERMS}, q AS (SELECT id AS query_id, term, weight AS qw FROM bm WHERE id % 50 = 0),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM q GROUP BY query_id),
s AS (SELECT q.query_id, bm.id, sum(qw * weight) AS s FROM q JOIN bm ON q.term = bm.term GROUP BY ALL),
sp AS (SELECT s.query_id, id, round(s / CASE WHEN qn > 0 THEN qn ELSE 1 END, 4) AS score FROM s JOIN qn ON s.query_id = qn.query_id),
sparse AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp QUALIFY rank <= 10)"""


#: Scores this near can be one when rounded to four digits.
ROUNDED = 1.1e-4


def _sparse(spark, sf, k=10):
    index = index_table(spark, sf)
    q = index.where("id % 50 = 0").select(F.col("id").alias("query_id"), "term", "weight")
    s = R.sparse_nearest(index, q, k, slack=ROUNDED).withColumn("score", F.round("score", 4))
    return R.top_k(s, k, ["query_id"])


@query(_SPARSE_SQL + " SELECT query_id, id, score, rank FROM sparse")
def sparse_topk(spark, sf):
    return _sparse(spark, sf)


@query(
    _SPARSE_SQL.replace("AS score FROM s JOIN qn ON s.query_id = qn.query_id", "AS score FROM s JOIN qn ON s.query_id = qn.query_id JOIN documents dd ON dd.doc_id = s.id WHERE dd.lang = 'en'")
    + " SELECT query_id, id, score, rank FROM sparse"
)
def sparse_topk_filtered(spark, sf):
    index = index_table(spark, sf)
    q = index.where("id % 50 = 0").select(F.col("id").alias("query_id"), "term", "weight")
    allow = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    s = R.sparse_nearest(index.join(allow, "id", "left_semi"), q, 10, slack=ROUNDED).withColumn("score", F.round("score", 4))
    return R.top_k(s, 10, ["query_id"])


_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_DENSE_SQL = f"""dense AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT.format(a='q.embedding', b='e.embedding')}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label")


def _dense(spark, sf, k, vectors=None, **options):
    """Candidates of the k best; top_k() ranks them."""
    v = _vectors(spark, sf)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
    return R.nearest(v if vectors is None else vectors, q, k, **options).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id AS id, round({_DOT.format(a='(SELECT embedding FROM embeddings WHERE vec_id = 7)', b='embedding')}, 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def dense_topk(spark, sf):
    v = _vectors(spark, sf)
    q = v.where("id = 7").select("dense").first()[0]
    return R.dense_topk(v, q, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_DENSE_SQL} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense QUALIFY rank <= 10")
def dense_batch_topk(spark, sf):
    return R.top_k(_dense(spark, sf, 10), 10, ["query_id"])


@query(f"WITH {_DENSE_SQL} SELECT query_id, dense.id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense.id) AS rank FROM dense JOIN embeddings e ON e.vec_id = dense.id WHERE e.label IN (1, 3, 5) QUALIFY rank <= 5")
def dense_topk_filtered(spark, sf):
    v = _vectors(spark, sf).where(F.col("label").isin(1, 3, 5))
    return R.top_k(_dense(spark, sf, 5, v), 5, ["query_id"])


@query(
    f"""WITH {_DENSE_SQL}, per AS (SELECT query_id, dense.id, score, e.label AS part FROM dense JOIN embeddings e ON e.vec_id = dense.id QUALIFY row_number() OVER (PARTITION BY query_id, e.label ORDER BY score DESC, dense.id) <= 3)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM per QUALIFY rank <= 10"""
)
def dense_topk_per_collection(spark, sf):
    per = R.top_k(_dense(spark, sf, 3, by="label"), 3, ["query_id", "label"], rank="r").drop("r", "label")
    return R.top_k(per, 10, ["query_id"])


@query(
    f"""WITH {_DENSE_SQL}, hot AS (SELECT * FROM dense WHERE id % 3 <> 0), cold AS (SELECT query_id, id, score FROM dense WHERE id % 2 = 0)
SELECT query_id, id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, id) AS rank FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold) GROUP BY query_id, id QUALIFY rank <= 10"""
)
def dense_hot_cold_merge(spark, sf):
    v = _vectors(spark, sf)
    hot, cold = (_dense(spark, sf, 10, v.where(c)) for c in ("id % 3 <> 0", "id % 2 = 0"))
    merged = hot.unionByName(cold).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return R.top_k(merged, 10, ["query_id"])


_RRF_SQL = f"""{_SPARSE_SQL.replace('rank <= 10', 'rank <= 24')}, {_DENSE_SQL}, dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense QUALIFY rank <= 24),
fused AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, coalesce(CAST(1.0 AS DOUBLE) / (60 + d.rank), 0) + coalesce(CAST(0.85 AS DOUBLE) / (60 + s.rank), 0) AS rrf,
 concat_ws('+', CASE WHEN d.id IS NOT NULL THEN 'dense' END, CASE WHEN s.id IS NOT NULL THEN 'sparse' END) AS contributors FROM dr d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id)"""


def _fused(spark, sf):
    d = R.top_k(_dense(spark, sf, 24), 24, ["query_id"])
    return R.reciprocal_rank_fusion(d, _sparse(spark, sf, 24), ["query_id"])


@query(_RRF_SQL + " SELECT query_id, id, round(rrf, 8) AS rrf, contributors, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 8) DESC, id) AS rank FROM fused QUALIFY rank <= 12")
def rrf_hybrid(spark, sf):
    f = _fused(spark, sf).withColumn("rrf", F.round("rrf", 8))
    return R.top_k(f, 12, ["query_id"], score="rrf").select("query_id", "id", "rrf", "contributors", "rank")


_FINAL_SQL = f"""WITH pts AS (SELECT * FROM points), {_RRF_SQL[5:]},
sc AS (SELECT f.query_id, f.id, pow(CAST(0.5 AS DOUBLE), greatest(0, {NOW} - p.last_access_at) / (21 * 86400.0)) AS recency, least(1.0, ln(1.0 + p.access_count) / ln(50.0)) AS salience, f.rrf * 60 AS sim, p.* EXCLUDE (id) FROM fused f JOIN pts p ON p.id = f.id)
SELECT query_id, id, round(recency, 6) AS recency, round(salience, 6) AS salience, round(greatest(0, CAST(0.62 AS DOUBLE) * sim + CAST(0.18 AS DOUBLE) * recency + CAST(0.10 AS DOUBLE) * salience + CAST(0.10 AS DOUBLE) * confidence + CASE WHEN pinned THEN 0.08 ELSE 0 END - CASE WHEN stale THEN 0.25 ELSE 0 END - CASE WHEN superseded_by IS NOT NULL THEN 0.55 ELSE 0 END), 6) AS score,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 10"""


def _final_sql() -> str:
    from .views import POINTS_SQL

    return "WITH " + POINTS_SQL + ", " + _FINAL_SQL[5:].replace("pts AS (SELECT * FROM points)", "pts AS (SELECT * FROM points)")


def hybrid_final_score(spark, sf):
    p = points(spark, sf).drop("text", "dense")
    s = _fused(spark, sf).join(p, "id").withColumn("f", R.final_score(F.col("rrf") * 60, NOW))
    flat = s.select("query_id", "id", F.round("f.recency", 6).alias("recency"), F.round("f.salience", 6).alias("salience"), F.round("f.score", 6).alias("score"))
    return R.top_k(flat, 10, ["query_id"])


def _register_final() -> None:
    from . import registry

    registry._QUERIES["hybrid_final_score"] = hybrid_final_score
    registry._SQL["hybrid_final_score"] = _final_sql()


_register_final()


@query(
    """SELECT id, round(pow(CAST(0.5 AS DOUBLE), greatest(0, 1706745600.0 - last_access_at) / (21 * 86400.0)), 6) AS recency, round(least(1.0, ln(1.0 + access_count) / ln(50.0)), 6) AS salience,
 round(greatest(0, CAST(0.62 AS DOUBLE) * 0.5 + CAST(0.18 AS DOUBLE) * pow(CAST(0.5 AS DOUBLE), greatest(0, 1706745600.0 - last_access_at) / (21 * 86400.0)) + CAST(0.1 AS DOUBLE) * least(1.0, ln(1.0 + access_count) / ln(50.0)) + CAST(0.1 AS DOUBLE) * confidence + CASE WHEN pinned THEN 0.08 ELSE 0 END - CASE WHEN stale THEN 0.25 ELSE 0 END - CASE WHEN superseded_by IS NOT NULL THEN 0.55 ELSE 0 END), 6) AS score FROM points"""
)
def score_breakdown(spark, sf):
    s = points(spark, sf).withColumn("f", R.final_score(F.lit(0.5), NOW))
    return s.select("id", *[F.round(f"f.{c}", 6).alias(c) for c in ("recency", "salience", "score")])


_GROUPS = "tokens AS (SELECT CAST(label AS INT) AS id, vec_id AS pos, embedding AS vec FROM embeddings), qs AS (SELECT CAST(vec_id // 250 AS BIGINT) AS query_id, vec_id AS qpos, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0)"


def _multivectors(spark, sf):
    e = table(spark, sf, "embeddings")
    tokens = e.select(F.col("label").cast("int").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    q = e.where("vec_id % 50 = 0").select(F.expr("vec_id DIV 250").alias("query_id"), F.col("vec_id").alias("qpos"), F.col("embedding").alias("qvec"))
    return q, tokens


@query(
    f"""WITH {_GROUPS}, sims AS (SELECT query_id, qpos, id, max(list_cosine_similarity(CAST(qvec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS best FROM qs, tokens GROUP BY ALL)
SELECT query_id, id, round(avg(best), 6) AS maxsim, round(0.75 * avg(best) + 0.25 * (1.0 / (1 + id)), 6) AS blended FROM sims GROUP BY query_id, id"""
)
def maxsim_rerank(spark, sf):
    m = R.maxsim(*_multivectors(spark, sf))
    return m.select("query_id", "id", F.round("maxsim", 6).alias("maxsim"), F.round(R.blend(F.col("maxsim"), 1.0 / (1 + F.col("id"))), 6).alias("blended"))


@query("SELECT a.label AS label, count(DISTINCT a.vec_id) + 1 AS n, round(avg(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS redundancy FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def mmr_redundancy(spark, sf):
    return R.redundancy(_vectors(spark, sf), ["label"]).select("label", "n", F.round("redundancy", 6).alias("redundancy"))


@query()
def mmr_select(spark, sf):
    c = R.top_k(_dense(spark, sf, 24), 24, ["query_id"]).join(_vectors(spark, sf).select("id", "dense"), "id")
    return R.mmr(c.select("query_id", "id", "score", "dense"), "query_id", 8)


@query(
    f"""WITH {_DENSE_SQL}, g AS (SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) - score AS gap FROM dense WHERE id <> query_id),
k AS (SELECT query_id, id, gap, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS in_gap FROM g WHERE gap <= 0.1)
SELECT query_id, id, round(gap, 6) AS gap, rank, in_gap FROM k WHERE rank <= 5"""
)
def conformal_set(spark, sf):
    s = R.conformal_set(_dense(spark, sf, None, within=0.1, others=True), ["query_id"], 0.1, 5)
    return s.select("query_id", "id", F.round("gap", 6).alias("gap"), "rank", "in_gap")


_SAMPLES = "s AS (SELECT event_id AS o, value / 100.0 AS correct, (value + CAST(event_id % 17 AS DOUBLE)) / 100.0 AS top FROM events)"


def _samples(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("order"), (F.col("value") / 100.0).alias("correct"), ((F.col("value") + (F.col("event_id") % 17).cast("double")) / 100.0).alias("top"))


@query(
    f"""WITH {_SAMPLES}, l AS (SELECT greatest(0, top - correct) AS g FROM s ORDER BY o DESC LIMIT 512), n AS (SELECT count(*) AS n, list_sort(list(g)) AS gs FROM l)
SELECT n, round(CASE WHEN ceil((n + 1) * 0.9) > n THEN NULL ELSE gs[CAST(ceil((n + 1) * 0.9) AS INT)] END, 6) AS gap FROM n"""
)
def conformal_quantile(spark, sf):
    return R.conformal_quantile(_samples(spark, sf)).select("n", F.round("gap", 6).alias("gap"))


@query(f"WITH {_SAMPLES}, c AS (SELECT count(*) AS n, avg(CAST(greatest(0, top - correct) <= 0.14 AS INT)) AS c FROM s) SELECT n, round(c, 6) AS coverage, c < 0.9 - 2 * sqrt(0.09 / n) AS drift FROM c")
def conformal_coverage(spark, sf):
    return R.coverage(_samples(spark, sf), 0.14).withColumn("coverage", F.round("coverage", 6))


@query(
    f"""WITH {_DENSE_SQL}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense WHERE id <> query_id), t AS (SELECT query_id, min(id) AS id FROM r WHERE id > query_id GROUP BY query_id)
SELECT count(*) AS probes, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, round(avg(CAST(rank = 1 AS INT)), 6) AS recall1 FROM t JOIN r USING (query_id, id)"""
)
def probe_mrr(spark, sf):
    r = R.top_k(_dense(spark, sf, 10, others=True), 10, ["query_id"])
    ids = _vectors(spark, sf).select("id")
    q = ids.where("id % 50 = 0").select(F.col("id").alias("query_id"))
    truth = q.join(ids, F.col("id") == F.col("query_id") + 1)
    rr = R.reciprocal_ranks(r, truth)
    return rr.agg(F.count("*").alias("probes"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg((F.col("rr") == 1).cast("int")), 6).alias("recall1"))


@query(
    f"""WITH {_DENSE_SQL}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense QUALIFY rank <= 10),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, id) AS rank FROM dense QUALIFY rank <= 10)
SELECT a.query_id, round(count(*) / 10.0, 4) AS overlap FROM a JOIN b ON a.query_id = b.query_id AND a.id = b.id GROUP BY a.query_id"""
)
def bake_off_overlap(spark, sf):
    s = _dense(spark, sf, 10, slack=0.11)  # also what rounding to one digit makes a tie
    a, b = R.top_k(s, 10, ["query_id"]), R.top_k(s.withColumn("score", F.round("score", 1)), 10, ["query_id"])
    return R.overlap_at_k(a, b, ["query_id"], 10).select("query_id", F.round("overlap", 4).alias("overlap"))


@query("SELECT source AS value, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count DESC, value LIMIT 12")
def facet_counts(spark, sf):
    return R.facet(table(spark, sf, "documents"), "source", 12)


@query(
    """, m AS (SELECT id, id % 7 AS mentions FROM points WHERE id % 3 = 0)
SELECT p.id, round(coalesce(0.12 * m.mentions / (SELECT max(mentions) FROM m), 0), 6) AS graph_boost FROM points p LEFT JOIN m ON p.id = m.id"""
)
def graph_boost(spark, sf):
    p = points(spark, sf).select("id")
    m = p.where("id % 3 = 0").select("id", (F.col("id") % 7).alias("mentions"))
    peak = m.agg(F.max("mentions")).first()[0] or 1
    return p.join(m, "id", "left").select("id", F.round(F.coalesce(F.lit(0.12) * F.col("mentions") / peak, F.lit(0.0)), 6).alias("graph_boost"))


@query(
    """, c AS (SELECT lang AS namespace, text, id AS payload, last_access_at AS created_at, id % 2 AS epoch FROM points WHERE id % 11 = 0),
l AS (SELECT lang AS namespace, text, id AS lookup FROM points)
SELECT l.lookup, c.payload FROM l JOIN c ON l.namespace = c.namespace AND regexp_replace(lower(trim(l.text)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(c.text)), '\\s+', ' ', 'g') WHERE c.epoch = 0 AND 1704500000.0 - c.created_at <= 400000"""
)
def exact_cache(spark, sf):
    p = points(spark, sf)
    c = p.where("id % 11 = 0").select(F.col("lang").alias("namespace"), "text", F.col("id").alias("payload"), F.col("last_access_at").alias("created_at"), (F.col("id") % 2).alias("epoch"))
    looked = p.select(F.col("lang").alias("namespace"), "text", F.col("id").alias("lookup"))
    return R.cache_hits(looked, c.drop("x"), 1704500000.0, ttl_s=400000.0).select("lookup", "payload")


@query(
    f"""WITH {_DENSE_SQL}, c AS (SELECT d.query_id, d.id, d.score FROM dense d JOIN embeddings q ON q.vec_id = d.query_id JOIN embeddings e ON e.vec_id = d.id WHERE q.label = e.label AND d.id <> d.query_id)
SELECT query_id, id, score, score >= 0.97 AS hit FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1"""
)
def semantic_cache(spark, sf):
    v = _vectors(spark, sf)
    s = _dense(spark, sf, 1, by="label", others=True).join(v.select(F.col("id").alias("query_id"), F.col("label").alias("lq")), "query_id").where("label = lq")
    return R.top_k(s, 1, ["query_id"]).select("query_id", "id", "score", (F.col("score") >= 0.97).alias("hit"))


@query("SELECT id, access_count FROM points ORDER BY access_count DESC, created_at DESC, id LIMIT 256")
def cache_eviction(spark, sf):
    return R.evict(points(spark, sf), 256, [F.desc("access_count"), F.desc("created_at"), F.col("id")]).select("id", "access_count")


# --------------------------------------------------------- text understanding


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:5], ' ') AS head FROM documents")
def tokenize(spark, sf):
    t = T.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


_SHORT = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN " + _STOP + " AND length(x) > 2)"


@query(
    f"""WITH {_TERMS}, asked AS (SELECT DISTINCT term FROM (SELECT id, term FROM bm WHERE id % 50 = 0 AND NOT contains(term, '_') AND length(term) > 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 3)),
d AS (SELECT doc_id, {_SHORT} AS all_w, list_distinct({_SHORT}) AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS a FROM d),
co AS (SELECT x.a AS term, y.a AS other, count(*) AS n FROM u x JOIN asked ON asked.term = x.a JOIN u y ON x.doc_id = y.doc_id AND x.a <> y.a GROUP BY ALL),
tot AS (SELECT term, sum(n) AS total FROM co GROUP BY term), voc AS (SELECT a, count(*) AS c FROM (SELECT unnest(all_w) AS a FROM d) GROUP BY a),
dn AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs FROM d),
r AS (SELECT term, other, n, row_number() OVER (PARTITION BY term ORDER BY n DESC, other) AS rn FROM co),
s AS (SELECT r.term, r.other, round(r.n / tot.total * ln(1 + docs / greatest(voc.c, 1)), 8) AS score FROM r JOIN tot USING (term) JOIN voc ON voc.a = r.other, dn WHERE rn <= 24)
SELECT term, other, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, other) AS rank FROM s QUALIFY rank <= 3"""
)
def cooccurrence_expand(spark, sf):
    from ..operators.vocabulary import expansions

    words = index_table(spark, sf).where("id % 50 = 0 and not contains(term, '_') and length(term) > 2")
    asked = R.top_k(words, 3, ["id"], score="weight", tie="term").select("term")
    return expansions(_texts(spark, sf), asked, 24, 3).withColumn("score", F.round("score", 8)).select("term", "other", "score", "rank")


@query(
    f"""WITH v AS (SELECT word, count(*) AS n FROM (SELECT unnest({_SHORT}) AS word FROM documents) GROUP BY word),
t AS (SELECT DISTINCT concat(substr(word, 1, 2), 'q', substr(word, 4)) AS token FROM v WHERE length(word) >= 5 AND n >= 20),
u AS (SELECT token, CASE WHEN length(token) <= 5 THEN 1 ELSE 2 END AS tolerance FROM t WHERE NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ({", ".join(f"'{w}'" for w in [*T.PROTECTED_WORDS, *T.STOP_WORDS])}) AND token NOT IN (SELECT word FROM v))
SELECT token, word AS best, d FROM (SELECT token, word, n, levenshtein(token, word) AS d, tolerance FROM u JOIN v ON abs(length(word) - length(token)) <= 2 AND length(word) BETWEEN 3 AND 40)
WHERE d <= tolerance QUALIFY row_number() OVER (PARTITION BY token ORDER BY d, n DESC, word) = 1"""
)
def spell_correct(spark, sf):
    from ..operators.vocabulary import correct, vocabulary

    v = vocabulary(_texts(spark, sf))
    typos = v.where("length(word) >= 5 AND n >= 20").select(F.concat(F.substring("word", 1, 2), F.lit("q"), F.expr("substring(word, 4)")).alias("token")).distinct()
    return correct(typos, v)


@query(
    """, t AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM notes),
h AS (SELECT id, len(list_filter(k, lambda x: x IN ('sensor','reading','telemetry','measurement','vibration','temperature'))) AS a, len(list_filter(k, lambda x: x IN ('procedure','steps','how','recovery','fix','repair','checklist'))) AS b,
 len(list_filter(k, lambda x: x IN ('happened','yesterday','shift','event','when','log'))) AS c, len(list_filter(k, lambda x: x IN ('rule','policy','threshold','limit','definition','means'))) AS d FROM t)
SELECT id, CASE WHEN greatest(a,b,c,d) = 0 THEN NULL WHEN a = greatest(a,b,c,d) THEN 'sensor' WHEN b = greatest(a,b,c,d) THEN 'procedural' WHEN c = greatest(a,b,c,d) THEN 'episodic' ELSE 'semantic' END AS intent FROM h"""
)
def intent_route(spark, sf):
    return notes(spark, sf).select("id", T.intent(T.tokenize(F.col("text"))).alias("intent"))


@query(
    """, m AS (SELECT id, regexp_extract_all(text, '(?i)\\b(\\d+(?:\\.\\d+)?)\\s*(mm/s|mm|bar|nm|rpm|°?c|hz|kw|a|v|ms|s|min|h)\\b', 1) AS v, regexp_extract_all(text, '(?i)\\b(\\d+(?:\\.\\d+)?)\\s*(mm/s|mm|bar|nm|rpm|°?c|hz|kw|a|v|ms|s|min|h)\\b', 2) AS u FROM notes)
SELECT id, len(v) AS n, array_to_string(list_transform(u, lambda x: lower(x)), ',') AS units, round(coalesce(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))), 0), 3) AS total FROM m"""
)
def units_extract(spark, sf):
    u = T.units(F.col("text"))
    return notes(spark, sf).select("id", F.size(u).alias("n"), F.array_join(F.transform(u, lambda x: x["unit"]), ",").alias("units"), F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x["value"]), 3).alias("total"))


@query("SELECT id, CASE WHEN levenshtein(a, b) > 4 THEN 5 ELSE levenshtein(a, b) END AS d FROM (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)")
def bounded_levenshtein(spark, sf):
    """The two words of each part's name."""
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.bounded_levenshtein(w[0], w[1], 4).alias("d"))
