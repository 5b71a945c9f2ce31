"""What showed on larger tables only, on small ones made for it."""

import hashlib
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import contradiction, embedding, governance, learning, maintenance, oplog, retrieval, vocabulary
from engram.plans import q_storage, q_sync


def test_graph_boost_without_mentions(spark):
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 14, 0.4), (2, 8, 0.5), (2, 9, 0.4)], "query_id int, id int, score double")
    mentions = spark.createDataFrame([(1, 7, 0), (1, 14, 0), (2, 8, 1)], "query_id int, id int, mentions int")
    got = {(r.query_id, r.id): r.graph_boost for r in retrieval.graph_boost(scored, mentions, ["query_id"]).collect()}
    assert got == {(1, 7): 0.0, (1, 14): 0.0, (2, 8): 0.12, (2, 9): 0.0}


def test_audit_heads_single_chain(spark):
    rows = spark.range(130).select(F.col("id").alias("seq"), F.lit("a").alias("action"), F.col("id").cast("string").alias("subject"))
    log = governance.audit_chain(rows, 10)
    heads = {(r.level, r.block): r.hash for r in governance.audit_heads(log, 10, levels=1).collect()}
    assert set(heads) == {(0, b) for b in range(13)} | {(1, 0)}
    top = ""
    for b in range(13):
        top = hashlib.sha256(f"{top}|{b}|{heads[0, b]}".encode()).hexdigest()
    assert heads[1, 0] == top
    assert {(r.level, r.block) for r in governance.audit_heads(log, 10).collect()} >= {(1, 1), (2, 0)}


def test_clocks_of_large_ids(spark, tmp_path):
    """Arrivals stay in order where ids pass a million."""
    rows = [(i, 1704067200000 + (i * 37 % 11) * 1000, 0, "edge-0") for i in (1, 2, 3, 1_000_001, 1_100_003, 2_000_077, 5_999_999)]
    df = spark.createDataFrame(rows, "op_id long, wall_ms long, counter int, device_id string").withColumn("arrival", F.col("op_id") * 7919 % 100003)
    got = {r.op_id for r in oplog.not_monotonic(df, order=["arrival", "op_id"]).collect()}
    line = sorted(rows, key=lambda r: (r[0] * 7919 % 100003, r[0]))
    assert got == {b[0] for a, b in zip(line, line[1:]) if b[1] <= a[1]}


def test_fsck_beyond_a_thousand_generations(spark, monkeypatch):
    """A stray file whose number the manifest knows as well is that generation's own."""
    seg = spark.range(1100).select((F.col("id") * 1000).alias("lsn"), F.col("id").alias("generation"), F.lit(1).alias("point_id"))
    for m in (q_storage, q_sync):
        monkeypatch.setattr(m, "_segments", lambda *_: seg)
    have = [(g, g % 5 == 4) for g in range(1100) if g % 7 != 3] + [(g + 1000, False) for g in range(1100) if g % 4 == 0]
    want = sorted([(g, "orphan" if g >= 1100 else "corrupt" if bad else "ok") for g, bad in have] + [(g, "missing") for g in set(range(1100)) - {g for g, _ in have}])
    assert sorted(tuple(r) for r in q_storage._fsck(spark, "").select("generation", "status").collect()) == want
    from engram.operators.storage import fsck

    assert sorted(tuple(r) for r in fsck(*q_sync._damaged(spark, "")).select("generation", "status").collect()) == want


def test_required_cohort_of_whole_products(spark):
    df = spark.createDataFrame([(0.5 + 0.25 * k, n) for k in range(10) for n in (5015, 3, 12, 51, 999, 10007)], "sigma double, n int")
    got = [(r.sigma, r.n, r.c) for r in df.select("sigma", "n", learning.required_cohort(F.col("sigma"), F.col("n")).alias("c")).collect()]
    assert all(c == -(-int(s * 4) ** 2 * n // 16) for s, n, c in got)


def test_merge_classes_of_equal_arrivals(spark):
    rows = [(i, 1, 1_000 * (i * 7 % 10), 0, "d", i % 2) for i in range(10)]
    for n in (1, 3, 7):
        df = spark.createDataFrame(sorted(rows, key=lambda r: r[0] * 3 % 10), "op_id long, point_id int, wall_ms long, counter int, device_id string, arrival int").repartition(n)
        got = {r.op_id for r in oplog.merge_classes(df, "arrival", 1).where("class = 'accepted'").collect()}
        assert got == {0, 2, 4, 7}, n  # of 0 2 4 6 8 1 3 5 7 9


def test_similar_pairs_across_groups(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "GROUP", 7)
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(6, 8)), 10, 0) + 0.2 * rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)] + [(60, 0, None), (61, 0, [1.0, None] + [0.0] * 6), (62, None, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "id int, b int, dense array<double>")
    got = sorted((r.a, r.b) for r in maintenance.similar_pairs(df, 0.9, "b").collect())
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and v[i] @ v[j] >= 0.9]


def test_similar_pairs_put_out_no_candidates(spark):
    """No join of rows with rows: its output grew with the square of a block."""
    df = spark.range(20).select("id", F.lit(1).alias("b"), F.array(F.lit(1.0), F.lit(0.0)).alias("dense"))
    plan = maintenance.similar_pairs(df, 0.9, "b")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_searches_in_slices(spark, monkeypatch):
    """Scores of a slice of the queries are held at a time, and the result is that of all at once."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, dense array<double>").repartition(2)
    q = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
    monkeypatch.setattr(retrieval, "CELLS", 60)
    got = {(r.query_id, r.rank): r.id for r in retrieval.top_k(retrieval.nearest(rows, q, 3, others=True), 3, ["query_id"]).collect()}
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    assert got == {(i, r + 1): int(np.argsort(-s[i])[r]) for i in range(0, 50, 5) for r in range(3)}
    assert list(retrieval._slices(10, 25)) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]


def test_term_frequencies_in_parts(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(30_000)) for i in range(5)]
    df = spark.createDataFrame([*enumerate(texts), (5, None), (6, "")], "id int, text string").coalesce(1)
    tf = retrieval.term_frequencies(df)
    assert {r.id: (r.n, r.len) for r in tf.groupBy("id").agg(F.count("*").alias("n"), F.max("len").alias("len")).collect()} == {i: (59_999, 59_999) for i in range(5)}


def test_sparse_nearest(spark, monkeypatch):
    rng = np.random.default_rng(5)
    index = spark.createDataFrame([(i, f"t{t}", float(rng.integers(1, 40)) / 8) for i in range(60) for t in rng.choice(30, 6, replace=False)], "id long, term string, weight double").repartition(5)
    q = index.where("id % 4 = 0").select(F.col("id").alias("query_id"), "term", "weight").unionByName(spark.createDataFrame([(99, "nowhere", 1.0), (98, "t1", 1.0)], "query_id long, term string, weight double"))
    want = {(r.query_id, r.id): (round(r.score, 9), r.rank) for r in retrieval.top_k(retrieval.sparse_scores(index, q), 3, ["query_id"]).collect()}
    for cells, many in ((1 << 21, 1 << 14), (40, 4)):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "MANY_QUERIES", many)
        near = retrieval.sparse_nearest(index, q, 3)
        assert {(r.query_id, r.id): (round(r.score, 9), r.rank) for r in retrieval.top_k(near, 3, ["query_id"]).collect()} == want
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()


def test_related_pairs_in_groups(spark, monkeypatch):
    """Every pair once, whatever the groups; rare and frequent tokens; ids asked for on both sides."""
    rng = np.random.default_rng(6)
    sets = [{f"w{t}" for t in rng.choice(40, rng.integers(1, 12), p=np.arange(40, 0, -1) / 820)} for _ in range(70)]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)] + [(70, None), (71, "")], "id long, text string")
    want = {(i, j): len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) for i in range(70) for j in range(i + 1, 70) if len(sets[i] & sets[j]) >= max(2, 0.45 * min(len(sets[i]), len(sets[j]))) and min(len(sets[i]), len(sets[j])) >= 2}
    asked = df.where("id % 3 = 0")
    for group, common, cells in ((16_384, 200, 1 << 21), (16, 4, 64)):
        for name, v in (("GROUP", group), ("COMMON", common), ("CELLS", cells)):
            monkeypatch.setattr(contradiction, name, v)
        got = [(r.a, r.b, r.overlap) for r in contradiction.related_pairs(df, 0.45, 2).collect()]
        assert len(got) == len(want) and {(a, b): o for a, b, o in got} == want
        got = [(r.a, r.b) for r in contradiction.related_pairs(df, 0.45, 2, asked).collect()]
        assert sorted(got) == sorted((a, b) for a, b in want if a % 3 == 0 or b % 3 == 0)


def test_related_pairs_travel_packed(spark, monkeypatch):
    """Texts go to the groups some hundred in a row, and what a task puts out at a time follows CELLS."""
    kept, written = {}, contradiction.written
    monkeypatch.setattr(contradiction, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    rng = np.random.default_rng(16)
    sets = [{f"w{t}" for t in rng.choice(64, rng.integers(5, 40))} for _ in range(1500)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "id long, text string").coalesce(2)
    got = {(r.a, r.b): r.overlap for r in contradiction.related_pairs(df, 0.45, 5, digits=2).where("b < 150").collect()}
    assert kept["token-sets"].count() <= 4
    common = {(i, j): (len(sets[i] & sets[j]), min(len(sets[i]), len(sets[j]))) for i in range(150) for j in range(i + 1, 150)}
    assert got == {p: float((Decimal(c) / n).quantize(Decimal("0.01"), ROUND_HALF_UP)) for p, (c, n) in common.items() if c >= 5 and c >= 0.45 * n}

    import pyarrow as pa

    row = kept["token-sets"].orderBy(F.size("ids").desc()).limit(1).toArrow().drop_columns(["_g"])
    row = row.append_column("_left", pa.array([True])).append_column("_right", pa.array([True]))
    monkeypatch.setattr(contradiction, "CELLS", 4000)
    out = list(contradiction._counter(0.45, 5, None)(iter(row.to_batches())))
    assert len(out) > 20 and max(b.num_rows for b in out) <= 4000


def test_check_shuffles_no_pair(spark, monkeypatch):
    """Stated points meet all others by words or vectors in the tasks, whatever the blocks and slices."""
    rng = np.random.default_rng(17)
    words = [*T.NEGATIONS[5:-4].split("|")[2:5], "open", "closed", "up", "down", *(f"w{i}" for i in range(30))]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(90)] + [None, ""]
    v = rng.normal(size=(92, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, t, [float(x) for x in v[i]] if i % 3 else None, float(i * 7 % 40), 1 if i % 11 == 5 else None) for i, t in enumerate(texts)]
    points = spark.createDataFrame(rows, "id long, text string, dense array<double>, created_at double, superseded_by long").repartition(3)
    asked = points.where("id % 4 = 0").select("id", F.col("dense").alias("q"))
    sets = [set(re.findall("[a-z0-9]+", t or "")) - set(T.STOP_WORDS) for t in texts]
    live = {r[0]: r for r in rows if r[4] is None and r[1] is not None}
    said = {r.id: r.said for r in points.where("text is not null").select("id", T.polarity(F.col("text")).alias("said")).collect()}
    want = {}
    for a in live:
        for b in live:
            if a < b and (a % 4 == 0 or b % 4 == 0):
                c, less = len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))
                near = float(v[a] @ v[b]) if live[a][2] and live[b][2] else -1.0
                score = max(near, c / less if c >= 2 and c >= 0.4 * less else -1.0)
                x, y = said[a], said[b]
                signals = ["negation_flip"] * (x[0] != y[0]) + [f"antonym:{p}/{q}" for i, (p, q) in enumerate(T.ANTONYMS) if (x[1 + 2 * i] and y[2 + 2 * i]) or (x[2 + 2 * i] and y[1 + 2 * i])]
                if score >= 0.4 and signals:
                    want[(a, b) if live[a][3] <= live[b][3] else (b, a)] = (round(score, 9), signals)
    for many, cells, size, slots in ((16_384, 1 << 21, 4096, 1 << 26), (4, 60, 7, 300)):
        for name, value in (("MANY_QUERIES", many), ("CELLS", cells), ("ROWS", size), ("ASKED_BYTES", slots)):
            monkeypatch.setattr(contradiction, name, value)
        found = contradiction.check(asked, points, 0.4, 2)
        got = [((r.older, r.newer), (round(r.similarity, 9), r.signals)) for r in found.collect()]
        assert len(got) == len(want) > 100 and dict(got) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_partners_without_pairs(spark, monkeypatch):
    """Partners from bounded counts are those of all pairs; words that cannot be one are not counted."""
    for name, value in (("LISTED", 12), ("FIRST", 4), ("ROWS", 7), ("PAIRS", 50), ("HELD", 20), ("MANY_QUERIES", 5)):
        monkeypatch.setattr(vocabulary, name, value)
    rng = np.random.default_rng(5)
    words = [f"w{i:03d}" for i in range(200)]
    texts = [(i, " ".join(words[int(200 * x**3)] for x in rng.random(rng.integers(0, 40)))) for i in range(150)] + [(150, None), (151, "w000"), (152, "")]
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    terms = spark.createDataFrame([(words[i],) for i in (0, 1, 2, 5, 9, 14, 30, 60, 90, 140, 190, 199)] + [("absent",), ("w000",)], "term string")
    sets = [set((t or "").split()) for _, t in texts]
    lists = spark.createDataFrame([(sorted(s),) for s in sets], "words array<string>").repartition(3)
    near, total = vocabulary.partners(lists, terms, 4)
    got = {(r.term, r.other): r.n for r in near.collect()}
    want, sums = {}, {}
    for t in {r.term for r in terms.collect()}:
        n = {o: sum(t in s and o in s for s in sets) for o in words if o != t}
        want |= {(t, o): n[o] for o in sorted(words, key=lambda o: (-n.get(o, 0), o))[:4] if n.get(o)}
        sums |= {t: sum(n.values())} if sum(n.values()) else {}
    assert got == want and {r.term: r.total for r in total.collect()} == sums
    plain = {(r.term, r.other): r.n for r in vocabulary.cooccurrence(docs, terms).collect()}
    assert plain.items() >= want.items() and len(vocabulary.expansions(docs, terms, 4, 2).collect()) > 15


def test_partners_read_texts_twice(spark, monkeypatch):
    """However many terms are stated (before: twice for each 16,384), up to a bound on what is broadcast."""
    calls, together = [], vocabulary._together
    monkeypatch.setattr(vocabulary, "_together", lambda *x: calls.append(len(x[1])) or together(*x))
    words = spark.range(20_000).select(F.array(F.concat(F.lit("t"), "id"), F.lit("a"), F.lit("b")).alias("words"))
    near, total = vocabulary.partners(words, words.select(F.col("words")[0].alias("term")), 1)
    assert calls == [20_000, 20_000] and near.where("other = 'a' and n = 1").count() == 20_000 and total.where("total = 2").count() == 20_000


def test_text_embedding_of_groups(spark, monkeypatch):
    """Texts in many groups, two of one id, and a token with two vectors."""
    monkeypatch.setattr(embedding, "GROUP_BYTES", 200)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[j] for j in rng.integers(0, 60, rng.integers(1, 30)))) for i in range(80)] + [(5, "w1 w1 w2"), (90, None)]
    table = [(w, rng.normal(size=4).tolist()) for w in [*words[:50], "w1"]]
    df = spark.createDataFrame(texts, "id int, text string").repartition(4)
    t = spark.createDataFrame(table, "token string, vec array<double>")
    got = embedding.encode(df, t, 4).collect()
    assert len(got) == len(texts)
    for r in got:
        v = [x for i, text in texts if i == r.id for w in (text or "").split() for k, x in table if k == w]
        total = np.sum(v, axis=0) if v else None
        assert r.n == len(v) and (r.vec is None if total is None else np.allclose(r.vec, total / np.linalg.norm(total)))


def test_bm25_by_groups(spark, monkeypatch):
    """Groups and buckets of any number, ties by term, rows that share an id; no term is shuffled as a row."""
    from collections import Counter

    from engram.operators import lexical

    monkeypatch.setattr(lexical, "GROUP_BYTES", 200)
    monkeypatch.setattr(lexical, "BUCKET", 20)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)] + ["w", "the", "a", "Ümlaut", "Kin", "w1a", "w_1", "0w"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "the of"), (103, "one"), (7, "w1 w2 again")]
    got = {}
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for r in retrieval.bm25(df, top=12).collect():
        got.setdefault(r.id, []).append((-r.weight, r.term))

    def terms(t):
        k = [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in T.STOP_WORDS]
        return Counter(k + [f"{a}_{b}" for a, b in zip(k, k[1:])])

    found = [(i, terms(t)) for i, t in rows]
    df_, mean, want = Counter(w for _, t in found for w in t), sum(sum(t.values()) for _, t in found) / len(rows), {}
    for i, t in found:
        norm = 1.2 * (0.25 + 0.75 * sum(t.values()) / mean)
        want.setdefault(i, []).extend((-round(float(np.log(1 + (len(rows) - df_[w] + 0.5) / (df_[w] + 0.5))) * n * 2.2 / (n + norm), 6), w) for w, n in t.items())
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x)[:12] for i, x in want.items() if x}
    plan = retrieval.bm25(df.where("id <> 7"), top=12)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "hashpartitioning(term" not in plan
    assert retrieval.bm25(df.where("id > 100 and id < 103")).count() == 0


def test_index_search_holds_few(spark, monkeypatch, tmp_path):
    """Whatever is held at a time, the same rows are found."""
    from engram.operators import ann, quantize

    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, dense array<double>")
    m = quantize.IvfPq(v[:200], cells=3, parts=4)
    ann.write_index(rows.coalesce(1), m, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index")).coalesce(1)
    q = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
    near = v[::10] @ m.approximate(v).T
    for size, rescore in ((1 << 20, 400), (3000, 60), (3000, 400)):
        monkeypatch.setattr(ann, "HELD", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        got = {(r.query_id, r.rank): r.id for r in ann.search(index, m, q, 3, 3, rescore).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = {}
        for n in range(40):
            some = np.argsort(-near[n])[:rescore]
            want |= {(10 * n, k + 1): int(i) for k, i in enumerate(some[np.argsort(-(v[some] @ v[10 * n]))][:3])}
        assert got == want


def test_index_search_of_many_plans_once(spark, monkeypatch, tmp_path):
    """Survivors beyond what a task holds: the plan does not grow with them, and the rows stay the same, also where
    many are alike."""
    from engram.operators import ann, quantize

    rng = np.random.default_rng(18)
    v = np.round(rng.normal(size=(60, 8)), 1)[rng.integers(0, 60, 300)]
    v[200:] += 0.01 * rng.normal(size=(100, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, dense array<double>")
    m = quantize.IvfPq(v[100:], cells=4, parts=4)
    ann.write_index(rows, m, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    q = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("q"))
    for probes, rescore in ((4, 300), (2, 40), (3, 7), (1, 1)):
        plans, got = [], []
        for size in (1 << 20, rescore * 20):
            monkeypatch.setattr(ann, "HELD", size)
            found = ann.search(index, m, q, 5, probes, rescore)
            plans.append(found._jdf.queryExecution().optimizedPlan().toString())
            got.append(sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in found.collect()))
        assert got[0] == got[1] and len(got[0]) == 100 * min(5, rescore) and plans[1].count("MapInArrow") == 1


def test_index_search_memory(spark, monkeypatch):
    """What a task of an index search holds follows HELD."""
    import tracemalloc
    from types import SimpleNamespace as Some

    import pyarrow as pa

    from engram.operators import ann, quantize

    class Index:
        where = select = lambda self, *_: self

        def mapInArrow(self, f, _):
            self.f = f
            raise StopIteration

    rng = np.random.default_rng(9)
    v = rng.normal(size=(1000, 8))
    m, index = quantize.IvfPq(v[:300], cells=1, parts=4), Index()
    monkeypatch.setattr(ann, "HELD", 100_000)
    try:
        ann._search_block(Some(sparkContext=Some(broadcast=lambda x: Some(value=x))), index, m, pa.array(range(100)), v[:100], 1, 1000, {"query_id": "long", "id": "long"})
    except StopIteration:
        pass
    codes = pa.array([c.tobytes() for c in m.pq.encode(v - m.cells[0])], pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(range(1000 * i, 1000 * i + 1000)), codes, pa.array(np.zeros(1000, np.int32))], names=["id", "codes", "cell"]) for i in range(12)]
    tracemalloc.start()
    found = pa.Table.from_batches(index.f(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 100_000 and peak < 16e6, peak
