"""Layered small-world graphs over vectors, one a shard.

Vectors are dealt to shards of bounded size. Each shard's graph is built in one task: a node's
candidates are its nearest in the shard (exact, by matrix products), of which a diverse choice
become its links; sparser upper layers lead a search to the right region. Graph and vectors are
tables (nodes, edges), so they can be stored, joined and changed. A search broadcasts a block of
queries; each shard answers for all of them at once by beam search, and the shards' answers are
merged. Removed nodes still lead the way, their neighbours are linked to each other, and they
are not answers any more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .retrieval import _matrix, query_blocks, top_k

#: Rows of a shard, links of a node (twice as many on the lowest layer), candidates for them.
SHARD_ROWS, DEGREE, CANDIDATES = 4096, 16, 64
#: Queries that a shard answers at a time, and the beam on upper layers.
TOGETHER, UPPER = 256, 8


def diverse(sims: np.ndarray, between: np.ndarray, degree: int) -> list[int]:
    """Of candidates in falling similarity those more like the node than like any chosen one; the
    best of the others fill up."""
    chosen: list[int] = []
    nearest_chosen = np.full(len(sims), -np.inf)
    for i in range(len(sims)):
        if len(chosen) == degree:
            break
        if nearest_chosen[i] < sims[i]:
            chosen.append(i)
            nearest_chosen = np.maximum(nearest_chosen, between[i])
    rest = [i for i in range(len(sims)) if i not in set(chosen)]
    return chosen + rest[: degree - len(chosen)]


def links(x: np.ndarray, degree: int, candidates: int, spread: bool = True) -> list[np.ndarray]:
    """For each row its outgoing links: a choice of its nearest rows, ties by position; spread: a
    diverse one, with the links of others to it where room is left."""
    n = len(x)
    k = min(candidates if spread else degree, n - 1)
    out: list[np.ndarray] = []
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        near = np.argsort(-s, axis=1, kind="stable")[:, :k]
        for r, c in enumerate(near):
            out.append(c[diverse(s[r, c], x[c] @ x[c].T, degree)] if spread else c)
    if not spread:
        return out
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own.tolist():
            back[j].append(i)
    room = 2 * degree
    for i, own in enumerate(out):
        more = np.setdiff1d(np.array(back[i], np.int64), own)
        if len(more):
            out[i] = np.concatenate([own, more[np.argsort(-(x[more] @ x[i]), kind="stable")][: room - len(own)]])
    return out


def level_of(key, degree: int = DEGREE) -> int:
    """A node's highest layer: each layer has about a degree-th of the nodes below."""
    u = (int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little") + 1) / 2**64
    return int(-math.log(u) / math.log(max(2, degree)))


def shards(df: DataFrame, key: str = "id", rows: int = SHARD_ROWS) -> int:
    return max(1, -(-df.count() // rows))


def build(df: DataFrame, n: int, key: str = "id", vec: str = "dense", degree: int = DEGREE, candidates: int = CANDIDATES, spread: bool = True) -> DataFrame:
    """The graphs of n shards (by key modulo n) as one table. Nodes: shard, layer (highest), src,
    vec (of unit length), removed; edges: shard, layer, src, dst."""
    kind = dict(df.dtypes)[key]

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, x = table.column("id"), _matrix(table.column("v").combine_chunks())
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        levels = np.array([level_of(i, degree) for i in ids.to_pylist()])
        src, dst, layer = [], [], []
        for at in range(int(levels.max()) + 1 if spread else 1):
            own = np.flatnonzero(levels >= at) if spread else np.arange(len(x))
            for i, to in zip(own, links(x[own], degree, candidates, spread)):
                src.append(np.full(len(to), i)), dst.append(own[to]), layer.append(np.full(len(to), at))
        s, d, y = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (src, dst, layer))
        m, one = len(x), table.column("shard")[0].as_py()
        vecs = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        none = pa.nulls(len(s), vecs.type)
        return pa.Table.from_arrays(
            [pa.array(np.full(m + len(s), one, np.int64)), pa.array(np.concatenate([levels, y]).astype(np.int32)), pa.concat_arrays([ids.combine_chunks(), ids.take(pa.array(s)).combine_chunks()]), pa.concat_arrays([pa.nulls(m, ids.type), ids.take(pa.array(d)).combine_chunks()]), pa.concat_arrays([vecs, none])],
            names=["shard", "layer", "src", "dst", "vec"],
        )

    rows = df.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.pmod(F.col(key), F.lit(n)).cast("long").alias("shard"), F.col(key).alias("id"), V.doubles(F.col(vec)).alias("v"))
    return rows.groupBy("shard").applyInArrow(grow, f"shard long, layer int, src {kind}, dst {kind}, vec array<double>").withColumn("removed", F.lit(False))


def beam(x: np.ndarray, links_: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (row of q) the best `width` nodes met from its entries: similarities and
    nodes, falling; -1 where fewer were met. links_: nodes x degree, padded by -1."""
    m = len(q)
    seen = np.zeros((m, len(x)), bool)
    who = np.arange(m)[:, None]
    node, sim = np.full((m, width), -1), np.full((m, width), -np.inf)
    done = np.ones((m, width), bool)

    def add(new: np.ndarray) -> None:
        nonlocal node, sim, done
        fresh = (new >= 0) & ~seen[who, np.maximum(new, 0)]
        fresh &= ~np.triu(new[:, :, None] == new[:, None, :], 1).any(axis=1)  # once a node
        seen[np.nonzero(fresh)[0], new[fresh]] = True
        s = np.where(fresh, np.einsum("mkd,md->mk", x[np.maximum(new, 0)], q), -np.inf)
        node, sim, done = (np.concatenate(v, axis=1) for v in ((node, np.where(fresh, new, -1)), (sim, s), (done, ~fresh)))
        order = np.argsort(-sim, axis=1, kind="stable")[:, :width]
        node, sim, done = (np.take_along_axis(v, order, 1) for v in (node, sim, done))

    add(entries)
    while not done.all():
        at = np.argmin(done, axis=1)  # the best node whose links are not followed yet
        some = ~done[who[:, 0], at]
        done[who[:, 0], at] = True
        add(np.where(some[:, None], links_[np.where(some, node[who[:, 0], at], 0)], -1))
    return sim, node


def _answering(shared, k: int, ef: int):
    """A shard's answers to the broadcast queries."""

    def answer(table: pa.Table) -> pa.Table:
        ids, q = shared.value
        is_node = pa.compute.is_null(table.column("dst")).to_numpy(zero_copy_only=False)
        nodes, edges = table.filter(pa.array(is_node)).combine_chunks(), table.filter(pa.array(~is_node)).combine_chunks()
        order = pa.compute.sort_indices(nodes, [("layer", "descending"), ("src", "ascending")])
        nodes = nodes.take(order)
        names = nodes.column("src").combine_chunks()
        x, gone = _matrix(nodes.column("vec").combine_chunks()), nodes.column("removed").to_numpy(zero_copy_only=False)
        a, b = (pa.compute.index_in(edges.column(c).combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "dst"))
        layer, top = edges.column("layer").to_numpy(), int(nodes.column("layer")[0].as_py())
        adjacent = []
        for at in range(top + 1):
            here = np.flatnonzero(layer == at)
            here = here[np.argsort(a[here], kind="stable")]
            n = np.bincount(a[here], minlength=len(x))
            pad = np.full((len(x), max(1, int(n.max()) if len(n) else 1)), -1)
            pad[a[here], np.arange(len(here)) - np.repeat(np.cumsum(n) - n, n)] = b[here]
            adjacent.append(pad)
        found: list[list] = [[], [], []]
        for i in range(0, len(q), TOGETHER):
            part = q[i : i + TOGETHER]
            entry = np.zeros((len(part), 1), np.int64)  # the first of the highest layer
            for at in range(top, 0, -1):
                entry = beam(x, adjacent[at], part, entry, UPPER)[1]
            sim, node = beam(x, adjacent[0], part, entry, max(ef, k))
            sim = np.where((node < 0) | gone[np.maximum(node, 0)], -np.inf, sim)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            r, c = np.nonzero(np.take_along_axis(sim, best, 1) > -np.inf)
            at = best[r, c]
            found[0].append(i + r), found[1].append(node[r, at]), found[2].append(sim[r, at])
        who, node, sim = (np.concatenate([np.zeros(0, t), *v]).astype(t) for v, t in zip(found, (np.int64, np.int64, float)))
        return pa.Table.from_arrays([ids.take(pa.array(who)), names.take(pa.array(node)), pa.array(sim)], names=["query_id", "id", "score"])

    return answer


def search(graph: DataFrame, queries: DataFrame, k: int, ef: int = 64) -> DataFrame:
    """query_id, id, score (cosine), rank: the k best that a beam of ef finds in each shard."""
    out = None
    kind, own = dict(queries.dtypes)["query_id"], dict(graph.dtypes)["src"]
    for ids, q in query_blocks(queries):
        q = q / np.maximum(np.linalg.norm(q, axis=1), 1e-12)[:, None] if len(q) else q
        shared = graph.sparkSession.sparkContext.broadcast((ids, q))

        part = graph.groupBy("shard").applyInArrow(_answering(shared, k, ef), f"query_id {kind}, id {own}, score double")
        out = part if out is None else out.union(part)
    return top_k(out, k, ["query_id"])


def crosslinks(graph: DataFrame, gone: DataFrame, key: str = "id", most: int = 2 * DEGREE) -> DataFrame:
    """shard, layer, src, dst: the links that removing some nodes adds. All live nodes that a removed
    one leads to get links to each other on that layer, the smallest keys first, as long as a
    node has fewer than `most`. A node has at most `most` links, which bounds the pairs."""
    edges = graph.where("dst is not null").select("shard", "layer", "src", "dst")
    dead = gone.select(F.col(key).alias("src")).distinct()
    around = edges.join(dead, "src", "left_semi").join(dead.withColumnRenamed("src", "dst"), "dst", "left_anti")
    a, b = around.withColumnRenamed("dst", "x"), around.withColumnRenamed("dst", "y")
    pairs = a.join(b, ["shard", "layer", "src"]).where("x <> y").select("shard", "layer", F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
    fresh = pairs.join(edges, ["shard", "layer", "src", "dst"], "left_anti")
    held = edges.groupBy("shard", "layer", "src").agg(F.count("*").alias("held"))
    w = Window.partitionBy("shard", "layer", "src").orderBy("dst")
    ranked = fresh.join(held, ["shard", "layer", "src"], "left").withColumn("r", F.row_number().over(w) + F.coalesce("held", F.lit(0)))
    return ranked.where(F.col("r") <= most).select("shard", "layer", "src", "dst")


def remove(graph: DataFrame, gone: DataFrame, key: str = "id", most: int = 2 * DEGREE) -> DataFrame:
    """The graph with some nodes removed (marked, still on the way) and their neighbours linked."""
    dead = gone.select(F.col(key).alias("src"), F.lit(True).alias("_dead")).distinct()
    marked = graph.join(dead, "src", "left").withColumn("removed", F.col("removed") | (F.coalesce("_dead", F.lit(False)) & F.col("dst").isNull())).drop("_dead")
    more = crosslinks(graph, gone, key, most).select("shard", "layer", "src", "dst", F.lit(None).cast("array<double>").alias("vec"), F.lit(False).alias("removed"))
    return marked.unionByName(more)
