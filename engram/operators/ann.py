"""Approximate nearest neighbours from a stored index of inverted cells and product codes.

The index is a table partitioned by cell: id, codes, vector. A batch of queries looks into each
query's nearest cells only (the union of them filters partitions, so other files are not
opened), scores the codes there with table lookups for all queries of a block at once, and
reads vectors, again of those cells only, for the survivors, which are scored exactly. How
many cells and survivors a wanted recall takes is measured by quantize.calibrate() on
neighbours found exactly. coded_topk() and nearest() remain for exact results.

A batch with more survivors than a task may hold is searched in two passes of one plan each: tasks
count each query's scores by code in BINS steps, which tells the step of its last survivor, and then
score survivors exactly where they lie, so neither they nor their vectors are shuffled, and the
driver sees two numbers a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lexical import packed, unpacked
from .quantize import IvfPq
from .retrieval import _matrix, query_blocks, top_k

#: Scores kept in a task: queries of a block times survivors; as many more are taken in before the worst go.
HELD = 1 << 20
#: Queries of a large batch and rows that a task takes at a time, and steps of a query's scores.
SLICE, ROWS, BINS = 1024, 1 << 16, 1024


def _lists(table: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.to_pylist()), np.uint8).reshape(-1, width)


def encode(df: DataFrame, model: IvfPq, key: str = "id", vec: str = "dense") -> DataFrame:
    """id, cell, codes (a byte a part), vec of each row with a vector."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[key]

    def apply(batches):
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = _matrix(part.column(1))
                cell = m.assign(x)
                codes = m.pq.encode(x - m.cells[cell])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), part.column(1)], names=["id", "cell", "codes", "vec"])

    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), V.doubles(F.col(vec)).alias("vec"))
    return rows.mapInArrow(apply, f"id {kind}, cell int, codes binary, vec array<double>")


def write_index(df: DataFrame, model: IvfPq, path: str, key: str = "id", vec: str = "dense", mode: str = "error") -> None:
    """Writes the index, a folder a cell; mode 'append' adds rows to one of the same model. Large
    cells are written by several tasks, small ones share a task."""
    encode(df, model, key, vec).hint("rebalance", "cell").write.partitionBy("cell").mode(mode).parquet(path)


def search(index: DataFrame, model: IvfPq, queries: DataFrame, k: int, probes: int, rescore: int) -> DataFrame:
    """query_id, id, score, rank: of each query (query_id, q) the k best by exact score among the
    rescore best by code in its probes nearest cells. index: a table that write_index() wrote."""
    spark, out = index.sparkSession, None
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(index.dtypes)["id"]}
    for ids, q in query_blocks(queries):
        few = len(q) * rescore <= HELD
        found = _search_block(spark, index, model, ids, q, probes, rescore, kinds) if few else _search_many(spark, index, model, ids, q, k, probes, rescore, kinds)
        out = found if out is None else out.union(found)
    return top_k(out, k, ["query_id"])


class _Codes:
    """Scores by code of a large batch of queries, SLICE of them at a time."""

    def __init__(self, model: IvfPq, q: np.ndarray, near: np.ndarray, probes: int):
        self.model, self.q, self.near = model, q, near
        self.own = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int16)

    def slices(self, codes: np.ndarray, cells: np.ndarray):
        """For each slice: its first query, the end and the steps' lowest and width of each query, and parts of
        (queries, rows, scores)."""
        order = np.argsort(cells, kind="stable")
        ends = np.searchsorted(cells[order], np.arange(len(self.model.cells) + 1))
        for a in range(0, len(self.q), SLICE):
            b = min(a + SLICE, len(self.q))
            tables = self.model.pq.tables(self.q[a:b])
            low = self.near[a:b].min(1) + tables.min(2).sum(1)
            width = (self.near[a:b].max(1) + tables.max(2).sum(1) - low) / BINS
            yield a, b, low, np.where(width > 0, width, 1.0), self._parts(a, b, tables, codes, order, ends)

    def _parts(self, a, b, tables, codes, order, ends):
        for c in np.flatnonzero(np.diff(ends)).tolist():
            s = np.flatnonzero((self.own[a:b] == c).any(axis=1))
            step = max(1, HELD // 2 // max(1, len(s)))
            for i in range(ends[c], ends[c + 1] if len(s) else 0, step):
                rows = order[i : min(i + step, ends[c + 1])]
                score = np.repeat(self.near[a + s, c][:, None], len(rows), axis=1)
                for p in range(codes.shape[1]):
                    score += tables[s, p][:, codes[rows, p]]
                yield s, rows, score


def _gathered(batches, width: int):
    """A task's rows (codes, cell and others), their codes and cells, some at a time."""
    held = []
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            held.append(b.slice(i, ROWS))
            if sum(x.num_rows for x in held) >= ROWS:
                t, held = pa.Table.from_batches(held), []
                yield t, _lists(t.column("codes"), width), t.column("cell").to_numpy()
    if held:
        t = pa.Table.from_batches(held)
        yield t, _lists(t.column("codes"), width), t.column("cell").to_numpy()


def _search_many(spark, index: DataFrame, model: IvfPq, ids: pa.Array, q: np.ndarray, k: int, probes: int, rescore: int, kinds: dict) -> DataFrame:
    near, width = q @ model.cells.T, model.pq.parts
    part = index.where(F.col("cell").isin(np.unique(np.argsort(-near, axis=1, kind="stable")[:, :probes]).tolist()))
    shared = spark.sparkContext.broadcast((model, ids, q, near))

    def tally(batches):
        model, _, q, near = shared.value
        by = _Codes(model, q, near, probes)
        for _, codes, cells in _gathered(batches, width):
            for a, b, low, step, parts in by.slices(codes, cells):
                n = np.zeros((b - a) * BINS, np.int64)
                for s, _, score in parts:
                    at = np.clip((score - low[s, None]) / step[s, None], 0, BINS - 1).astype(np.int64)
                    n += np.bincount((s[:, None] * BINS + at).reshape(-1), minlength=len(n))
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([packed(n)], pa.binary())], names=["slice", "n"])

    def bound(t: pa.Table) -> pa.Table:
        """The step of each query's last survivor, and how many of that step survive."""
        n = sum(unpacked(x.as_py()) for x in t.column("n")).reshape(-1, BINS)
        above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1]  # in this step and those above
        at = (above >= rescore).sum(1) - 1
        more = np.append(above, np.zeros((len(n), 1), np.int64), axis=1)[np.arange(len(n)), at + 1]
        return pa.table({"q": t.column("slice")[0].as_py() + np.arange(len(n)), "at": at, "rest": rescore - more})

    told = part.select("codes", "cell").mapInArrow(tally, "slice long, n binary").groupBy("slice").applyInArrow(bound, "q long, at long, rest long").toArrow()
    last, rest = np.full(len(q), -1), np.zeros(len(q), np.int64)
    last[told.column("q").to_numpy()], rest[told.column("q").to_numpy()] = told.column("at").to_numpy(), told.column("rest").to_numpy()
    limits = spark.sparkContext.broadcast((last, rest))

    def best(batches):
        model, ids, q, near = shared.value
        last, rest = limits.value
        by = _Codes(model, q, near, probes)

        def cut(kept: list, least: np.ndarray) -> list:
            """Each query's best k so far, ties of the last included."""
            who, row, score = (np.concatenate([np.zeros(0, t), *(x[i] for x in kept)]) for i, t in enumerate((np.int64, np.int64, float)))
            order = np.lexsort((-score, who))
            who, row, score = who[order], row[order], score[order]
            per = np.bincount(who, minlength=len(least))
            full = np.flatnonzero(per >= k)
            least[full] = score[(np.cumsum(per) - per)[full] + k - 1]
            stays = score >= least[who]
            return [(who[stays], row[stays], score[stays])]

        for held, codes, cells in _gathered(batches, width):
            names, v = held.column("id").combine_chunks(), _matrix(held.column("vec").combine_chunks())

            def rows(who, row, score, approx, names=names):
                return pa.RecordBatch.from_arrays([ids.take(pa.array(who)), names.take(pa.array(row)), pa.array(score), approx, pa.array(rest[who])], names=["query_id", "id", "score", "approx", "rest"])

            for a, b, low, step, parts in by.slices(codes, cells):
                least, kept, new = np.full(b - a, -np.inf), [], 0
                for s, some, score in parts:
                    at = np.clip((score - low[s, None]) / step[s, None], 0, BINS - 1).astype(np.int64)
                    i, j = np.nonzero(at >= last[a + s, None])
                    for lo in range(0, len(i), HELD // 8):
                        x, y = i[lo : lo + HELD // 8], j[lo : lo + HELD // 8]
                        who, row = s[x], some[y]
                        exact = (q[a + who] * v[row]).sum(1)
                        edge = at[x, y] == last[a + who]
                        yield rows(a + who[edge], row[edge], exact[edge], pa.array(score[x[edge], y[edge]]))
                        sure = ~edge & (exact >= least[who])
                        kept.append((who[sure], row[sure], exact[sure]))
                        new += int(sure.sum())
                        if new > HELD // 4:
                            kept, new = cut(kept, least), 0
                who, row, exact = cut(kept, least)[0]
                yield rows(a + who, row, exact, pa.nulls(len(who), pa.float64()))

    found = part.select("id", "codes", "cell", "vec").mapInArrow(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, approx double, rest long")
    w = Window.partitionBy("query_id", F.col("approx").isNull()).orderBy(F.desc("approx"), "id")
    found = found.withColumn("_r", F.row_number().over(w)).where(F.col("approx").isNull() | (F.col("_r") <= F.col("rest")))
    return found.select("query_id", "id", "score")


def _search_block(spark, index: DataFrame, model: IvfPq, ids: pa.Array, q: np.ndarray, probes: int, rescore: int, kinds: dict) -> DataFrame:
    near = q @ model.cells.T if len(q) else np.zeros((0, len(model.cells)))
    own = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    asked = [np.flatnonzero((own == c).any(axis=1)) for c in range(len(model.cells))]
    cells = [c for c, s in enumerate(asked) if len(s)]
    tables = model.pq.tables(q) if len(q) else np.zeros((0, model.pq.parts, 256))
    shared = spark.sparkContext.broadcast((near, asked, tables, len(q)))

    def best(batches):
        near, asked, tables, n = shared.value
        parts, names, new, held = [], [], 0, 0
        least = np.full(n, -np.inf)  # a query's last survivor so far, if it has all

        def cut() -> tuple[np.ndarray, ...]:
            """Each query's best so far."""
            nonlocal new
            score, name, cell_of, who = (np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate((float, np.int64, np.int32, np.int32)))
            parts.clear()
            order = np.lexsort((-score, who))
            per = np.bincount(who, minlength=n)
            first = np.cumsum(per) - per
            full = np.flatnonzero(per >= rescore)
            least[full] = score[order[first[full] + rescore - 1]]
            keep = order[np.arange(len(order)) - np.repeat(first, per) < rescore]
            parts.append((score[keep], name[keep], cell_of[keep], who[keep]))
            new = 0
            return parts[0]

        for b in batches:
            codes, cells = _lists(b.column(1), tables.shape[1]), b.column(2).to_numpy()
            for c in np.unique(cells).tolist():
                rows = np.flatnonzero(cells == c)
                many = max(1, HELD // 2 // len(rows))
                for lo in range(0, len(asked[c]), many):
                    s = asked[c][lo : lo + many]
                    # a row for each query: the cell's product and one entry a part
                    approx = np.repeat(near[s, c][:, None], len(rows), axis=1)
                    for p in range(codes.shape[1]):
                        approx += tables[s, p][:, codes[rows, p]]
                    low = least[s]
                    if rescore < len(rows):
                        low = np.maximum(low, np.partition(approx, len(rows) - rescore, axis=1)[:, len(rows) - rescore])
                    i, j = np.nonzero(approx >= low[:, None])
                    parts.append((approx[i, j], held + rows[j], np.full(len(i), c, np.int32), s[i].astype(np.int32)))
                    new += len(i)
                    if new > HELD:
                        cut()
            names.append(b.column(0))
            held += b.num_rows
        score, name, cell_of, who = cut()
        if len(score):
            found = pa.chunked_array(names).take(pa.array(name)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int64)), found, pa.array(cell_of), pa.array(score)], names=["n", "id", "cell", "approx"])

    part = index.where(F.col("cell").isin(cells)) if cells else index.where(F.lit(False))
    scored = part.select("id", "codes", "cell").mapInArrow(best, f"n long, id {kinds['id']}, cell int, approx double")
    w = Window.partitionBy("n").orderBy(F.desc("approx"), "id")
    survivors = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rescore).select("n", "id", "cell")
    asked_for = spark.createDataFrame([(i, x, v) for i, (x, v) in enumerate(zip(ids.to_pylist(), q.tolist()))], f"n long, query_id {kinds['query_id']}, q array<double>")
    return survivors.join(part.select("id", "cell", "vec"), ["id", "cell"]).join(asked_for, "n").select("query_id", "id", V.dot(F.col("q"), F.col("vec")).alias("score"))
