"""Vector codes and fitted spaces: rotations, one-bit codes, product codes, whitening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import vectors as V


def fwht(rows: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; lengths of a power of two only."""
    n = rows.shape[1]
    if n & (n - 1) or n == 0:
        raise ValueError("the length must be a power of two")
    out, h = rows.astype(float).copy(), 1
    while h < n:
        pairs = out.reshape(len(out), n // (2 * h), 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        h *= 2
    return out / np.sqrt(n)


class Rotation:
    """An orthogonal map from a seed: three rounds of random signs and transform for powers of
    two, a dense orthogonal matrix otherwise."""

    def __init__(self, dims: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.fast = dims & (dims - 1) == 0
        self.signs = rng.choice([-1.0, 1.0], (3, dims)) if self.fast else None
        self.dense = None if self.fast else np.linalg.qr(rng.standard_normal((dims, dims)))[0]

    def apply(self, rows: np.ndarray) -> np.ndarray:
        if not self.fast:
            return rows @ self.dense.T
        for s in self.signs:
            rows = fwht(rows * s)
        return rows


def mean_vector(df: DataFrame, vec: str) -> np.ndarray:
    """Means by dimension: one row a dimension comes to the driver."""
    at = df.where(F.col(vec).isNotNull()).select(F.posexplode(V.doubles(F.col(vec))).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).collect()
    out = np.zeros(len(at))
    for r in at:
        out[r.p] = r.x
    return out


def one_bit_codes(df: DataFrame, center: np.ndarray, vec: str = "dense", seed: int = 7) -> DataFrame:
    """df with code (packed signs of the rotated unit residual), radius and factor (the residual's
    product with its code, for unbiased estimates)."""
    rotation = Rotation(len(center), seed)

    @pandas_udf("struct<code:binary,radius:double,factor:double>")
    def encode(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(float) - center
        r = np.linalg.norm(x, axis=1)
        u = rotation.apply(x / np.where(r > 0, r, 1)[:, None])
        signs = np.where(u > 0, 1.0, -1.0) / np.sqrt(u.shape[1])
        return pd.DataFrame({"code": [c.tobytes() for c in np.packbits(u > 0, axis=1)], "radius": r, "factor": (u * signs).sum(1)})

    return df.where(F.col(vec).isNotNull()).withColumn("_c", encode(vec)).select("*", "_c.code", "_c.radius", "_c.factor").drop("_c")


def one_bit_estimate(codes: DataFrame, query: np.ndarray, center: np.ndarray, seed: int = 7, z: float = 1.9) -> DataFrame:
    """codes with estimate and bound of the inner product with the query."""
    q = query - center
    length = float(np.linalg.norm(q)) or 1.0
    rotated = Rotation(len(center), seed).apply(q[None] / length)[0]
    base, dims = float(query @ center), len(center)

    @pandas_udf("struct<estimate:double,bound:double>")
    def estimate(code: pd.Series, radius: pd.Series, factor: pd.Series, dot_center: pd.Series) -> pd.DataFrame:
        bits = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in code]), axis=1)[:, :dims]
        signs = (2.0 * bits - 1) / np.sqrt(dims)
        f = np.maximum(factor.to_numpy(), 1e-9)
        inner = (signs @ rotated) / f
        error = z * np.sqrt(np.maximum(1 - f**2, 0) / f**2 / max(1, dims - 1))
        scale = radius.to_numpy() * length
        return pd.DataFrame({"estimate": scale * inner + dot_center.to_numpy() + base - float(center @ center), "bound": scale * error})

    c = F.array(*[F.lit(float(x)) for x in center])
    return codes.withColumn("_e", estimate("code", "radius", "factor", V.dot(F.col("dense"), c))).select("*", "_e.estimate", "_e.bound").drop("_e")


def shortlist(estimates: DataFrame, k: int) -> DataFrame:
    """Rows whose upper end reaches the k-th largest lower end: the true top k within the bounds."""
    kth = estimates.select((F.col("estimate") - F.col("bound")).alias("low")).orderBy(F.desc("low")).limit(k).agg(F.min("low")).first()[0]
    return estimates if kth is None else estimates.where(F.col("estimate") + F.col("bound") >= kth)


def kmeans(rows: np.ndarray, k: int, iterations: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of a bounded sample: k-means++ starts, Lloyd steps, early stop."""
    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    centres = [rows[rng.integers(len(rows))]]
    near = ((rows - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = near / near.sum() if near.sum() > 0 else None
        centres.append(rows[rng.choice(len(rows), p=p)])
        near = np.minimum(near, ((rows - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(iterations):
        own = ((rows**2).sum(1)[:, None] - 2 * rows @ c.T + (c**2).sum(1)).argmin(1)
        new = np.stack([rows[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-5:
            break
    return c


class ProductQuantizer:
    """Codebooks by subspace after a rotation, fit on a bounded sample."""

    def __init__(self, sample: np.ndarray, parts: int = 8, words: int = 256, rounds: int = 2, seed: int = 5):
        self.parts, self.dims = parts, sample.shape[1]
        self.rotation = np.eye(self.dims)
        for _ in range(rounds):
            x = sample @ self.rotation
            self.books = [kmeans(s, words, seed=seed) for s in np.split(x, parts, axis=1)]
            u, _, vt = np.linalg.svd(sample.T @ self.decode_rotated(self.encode(sample)))
            self.rotation = u @ vt
        x = sample @ self.rotation
        self.books = [kmeans(s, words, seed=seed) for s in np.split(x, parts, axis=1)]

    def encode(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for s, b in zip(np.split(rows @ self.rotation, self.parts, axis=1), self.books):
            out.append(((s**2).sum(1)[:, None] - 2 * s @ b.T + (b**2).sum(1)).argmin(1))
        return np.stack(out, 1).astype(np.uint8)

    def decode_rotated(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.decode_rotated(codes) @ self.rotation.T

    def approximate(self, rows: np.ndarray) -> np.ndarray:
        """What the codes of rows tell of them."""
        return self.decode(self.encode(rows))

    def table(self, query: np.ndarray) -> np.ndarray:
        """Inner products of the query's parts with all code words."""
        return np.stack([np.pad(b @ q, (0, 256 - len(b))) for b, q in zip(self.books, np.split(query @ self.rotation, self.parts))])

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """table() of many queries: (queries, parts, 256)."""
        parts = np.split(queries @ self.rotation, self.parts, axis=1)
        return np.stack([np.pad(x @ b.T, ((0, 0), (0, 256 - len(b)))) for b, x in zip(self.books, parts)], axis=1)


def coded_topk(df: DataFrame, model: ProductQuantizer | IvfPq, queries: DataFrame, k: int, block: int = 4096, key: str = "id", vec: str = "dense") -> DataFrame:
    """query_id, id, score, rank: for each query the k best vectors by inner product. Codes and
    the length of what they leave out bound each score; vectors whose upper bound reaches the
    k-th best lower bound are scored exactly, so none of the k is lost. queries: query_id, q."""
    spark = df.sparkSession
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).alias("v"))
    blocks = max(1, -(-queries.count() // block))
    out = None
    for n in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).select(F.col("query_id").cast("long"), "q").collect()
        if not part and blocks > 1:
            continue
        ids = np.array([r.query_id for r in part], np.int64)
        q = np.array([r.q for r in part], float) if part else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((model, ids, q, np.sqrt((q**2).sum(1))))

        def bounds(pdf, shared=shared):
            m, _, q, size = shared.value
            step = max(1, (1 << 21) // max(1, len(q)))
            for i in range(0, len(pdf) if len(q) else 0, step):
                x = np.stack(pdf["v"].to_numpy()[i : i + step]).astype(float)
                near = m.approximate(x)
                yield i, x, near @ q.T, np.sqrt(((x - near) ** 2).sum(1))[:, None] * size

        def lower(batches, shared=shared, bounds=bounds):
            best = np.full((0, len(shared.value[1])), -np.inf)
            for pdf in batches:
                for _, _, score, slack in bounds(pdf):
                    best = np.sort(np.concatenate([best, score - slack]), axis=0)[-k:]
            yield pd.DataFrame({"n": np.tile(np.arange(best.shape[1]), len(best)), "low": best.ravel()})

        w = Window.partitionBy("n").orderBy(F.desc("low"))
        kth = rows.select("v").mapInPandas(lower, "n long, low double").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        least = np.full(len(ids), -np.inf)
        for r in kth.where(F.col("r") == k).collect():
            least[r.n] = r.low - 1e-9
        limit = spark.sparkContext.broadcast(least)

        def exact(batches, shared=shared, limit=limit, bounds=bounds):
            _, ids, q, _ = shared.value
            best, names = np.full((0, len(ids)), -np.inf), np.zeros((0, len(ids)), np.int64)
            for pdf in batches:
                own = pdf["id"].to_numpy()
                for i, x, score, slack in bounds(pdf):
                    near = np.where(score + slack >= limit.value, x @ q.T, -np.inf)
                    best = np.concatenate([best, near])
                    names = np.concatenate([names, np.broadcast_to(own[i : i + len(x), None], near.shape)])
                    first = np.lexsort((names, -best), axis=0)[:k]
                    best, names = np.take_along_axis(best, first, 0), np.take_along_axis(names, first, 0)
            a, b = np.nonzero(best > -np.inf)
            yield pd.DataFrame({"query_id": ids[b], "id": names[a, b], "score": best[a, b]})

        hits = rows.select(F.col("id").cast("long").alias("id"), "v").mapInPandas(exact, "query_id long, id long, score double")
        out = hits if out is None else out.union(hits)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class IvfPq:
    """Coarse cells and product codes of the residuals."""

    def __init__(self, sample: np.ndarray, cells: int = 16, parts: int = 8):
        self.cells = kmeans(sample, cells)
        own = self.assign(sample)
        self.pq = ProductQuantizer(sample - self.cells[own], parts)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        return ((rows**2).sum(1)[:, None] - 2 * rows @ self.cells.T + (self.cells**2).sum(1)).argmin(1)

    def approximate(self, rows: np.ndarray) -> np.ndarray:
        near = self.cells[self.assign(rows)]
        return near + self.pq.approximate(rows - near)


def second_moments(df: DataFrame, vec: str = "dense") -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance; each task sends one matrix of dims x dims."""
    dims = len(df.where(F.col(vec).isNotNull()).select(vec).first()[0])

    def partial(batches):
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "q": [q.tobytes()]})

    rows = df.where(F.col(vec).isNotNull()).select(vec).mapInPandas(partial, "n long, s binary, q binary").collect()
    n = sum(r.n for r in rows)
    mean = sum(np.frombuffer(r.s) for r in rows) / max(1, n)
    cov = sum(np.frombuffer(r.q).reshape(dims, dims) for r in rows) / max(1, n) - np.outer(mean, mean)
    return n, mean, cov


def shrunk(cov: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Covariance moved toward a multiple of the identity, by how noisy it is."""
    d = len(cov)
    mu = np.trace(cov) / d
    spread = ((cov - mu * np.eye(d)) ** 2).sum()
    noise = (np.trace(cov) ** 2 + (cov**2).sum()) / max(1, n)
    w = float(np.clip(noise / spread if spread > 0 else 1.0, 0, 1))
    return (1 - w) * cov + w * mu * np.eye(d), w


class Whitening:
    """(v - mean) W over the leading directions, renormalised."""

    def __init__(self, n: int, mean: np.ndarray, cov: np.ndarray, energy: float = 0.95):
        cov, self.shrinkage = shrunk(cov, n)
        values, vectors = np.linalg.eigh(cov)
        self.values, vectors = values[::-1], vectors[:, ::-1]
        share = np.cumsum(self.values) / max(self.values.sum(), 1e-12)
        self.rank = int(np.searchsorted(share, energy) + 1)
        self.mean, self.w = mean, vectors[:, : self.rank] / np.sqrt(np.maximum(self.values[: self.rank], 1e-9))

    def energy(self, dims: int) -> float:
        return float(self.values[:dims].sum() / max(self.values.sum(), 1e-12))

    def ladder(self, steps: list[int]) -> list[tuple[int, float, int, float]]:
        full = len(self.values)
        return [(d, round(self.energy(d), 6), 4 * d, full / d) for d in steps if d <= full]

    def apply(self, rows: np.ndarray) -> np.ndarray:
        out = (rows - self.mean) @ self.w
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


class Projection:
    """The plane of the two leading directions of a covariance."""

    def __init__(self, n: int, mean: np.ndarray, cov: np.ndarray):
        values, vectors = np.linalg.eigh(cov)
        w = vectors[:, ::-1][:, :2]
        # a direction's sign is free: its largest entry is positive
        self.w = w * np.sign(w[np.abs(w).argmax(0), range(w.shape[1])])
        self.mean, self.explained = mean, [float(x) for x in values[::-1][:2] / max(values.sum(), 1e-12)]

    def project(self, vec: Column) -> list[Column]:
        """x and y of a vector: products with two literal arrays."""
        return [V.dot(F.array(*[F.lit(float(v)) for v in self.w[:, k]]), vec) - F.lit(float(self.mean @ self.w[:, k])) for k in (0, 1)]


def approximated(df: DataFrame, model: ProductQuantizer | IvfPq, vec: str = "dense") -> DataFrame:
    """df with the vectors that the codes stand for in place of vec."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("array<double>")
    def near(v: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.approximate(np.stack(v.to_numpy()).astype(float))))

    return df.where(F.col(vec).isNotNull()).withColumn(vec, near(vec))


def calibrate(df: DataFrame, model: IvfPq, queries: DataFrame, k: int, target: float = 0.95, key: str = "id", vec: str = "dense") -> dict[str, int]:
    """probes and rescore: how many cells to look into and how many rows to score exactly, so that
    for a share target of the stated queries all k nearest rows are among them. Measured: the
    rank of the neighbours' cells, and how many rows the codes place before the last neighbour."""
    from .retrieval import beaten, nearest, top_k

    best = top_k(nearest(df, queries, k, key=key, vec=vec), k, ["query_id"]).select("query_id", "id")
    rows = best.join(df.select(F.col(key).alias("id"), F.col(vec).alias("v")), "id").join(queries, "query_id").select("query_id", "q", "v")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("struct<cell:int,approx:double>")
    def measured(q: pd.Series, v: pd.Series) -> pd.DataFrame:
        m = shared.value
        a, b = np.stack(q.to_numpy()).astype(float), np.stack(v.to_numpy()).astype(float)
        order = np.argsort(-(a @ m.cells.T), axis=1)
        return pd.DataFrame({"cell": 1 + (order == m.assign(b)[:, None]).argmax(1).astype(np.int32), "approx": (a * m.approximate(b)).sum(1)})

    per = rows.withColumn("m", measured("q", "v")).groupBy("query_id").agg(F.max("m.cell").alias("cells"), F.min("m.approx").alias("least"))
    n = beaten(approximated(df, model, vec), queries.join(per, "query_id"), vec=vec)
    both = per.join(n, "query_id").agg(F.percentile("cells", target).alias("c"), F.percentile("n", target).alias("n")).first()
    return {"probes": int(np.ceil(both.c)), "rescore": int(np.ceil(both.n))}


def whiten(df: DataFrame, model: Whitening, vec: str = "dense", out: str = "white") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.apply(np.stack(v.to_numpy()).astype(float))))

    return df.where(F.col(vec).isNotNull()).withColumn(out, apply(vec))


def anisotropy(values: np.ndarray, mean: np.ndarray) -> dict[str, float | str]:
    """Effective rank, condition number and a verdict from a spectrum."""
    p = np.maximum(values, 0) / max(np.maximum(values, 0).sum(), 1e-12)
    rank = float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))
    cosine = float(mean @ mean)
    verdict = "isotropic" if cosine < 0.1 and rank / len(p) > 0.5 else "collapsed" if cosine > 0.5 or rank / len(p) < 0.1 else "anisotropic"
    return {"effective_rank": rank, "mean_cosine": cosine, "condition": float(values.max() / max(values[values > 0].min(), 1e-12)), "verdict": verdict}


def prune_late(tokens: DataFrame, budget: int, key: str = "id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """The budget token vectors of each row least like their centroid, in order."""
    from pyspark.sql import Window

    from .maintenance import centroid

    c = centroid(tokens, key, vec)
    scored = tokens.join(c, key).withColumn("_s", F.round(V.cosine(F.col(vec), F.col("centroid")), 9))
    w = Window.partitionBy(key).orderBy("_s", pos)
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget).drop("_s", "_r", "centroid")


def varint(value: Column) -> Column:
    """LEB128 bytes of a non-negative integer."""

    @pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            v, b = int(v), bytearray()
            while v > 127:
                b.append(v & 127 | 128)
                v >>= 7
            b.append(v)
            out.append(bytes(b))
        return pd.Series(out)

    return encode(value)
