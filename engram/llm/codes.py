"""Vector code compression: product codes with integer codebooks.

Each component x counts as the integer floor(256 * x); a vector is cut into equal consecutive
parts and each part is named by the nearest entry of its codebook. The codebooks start as the
parts of the vectors with the smallest ids. A round broadcasts them (parts x entries x width
integers, whatever the number of vectors); Arrow batches compute all distances by norm
expansion, |x|^2 - 2 x.c + |c|^2 with exact 64-bit matrix products, and take the first
smallest; each task sends one sum and count an entry, a grouped shuffle merges them, and an
entry becomes the floor of its mean. Entries that nothing chose stay.

Defined results: rows whose vector is null, holds null or a non-finite component, or has
another length than the first start vector are dropped; the first start vector is the smallest
by id (null ids last, then by components) whose length is a multiple of the number of parts. A
repeated row is coded again and counts again, also as a start. With fewer kept rows than entries there
are fewer entries. Components are held within a bound that keeps all distances in 64 bits
(2^27 for 64 components, that is |x| up to 524,288); sums of errors stop at the largest 64-bit
integer. An empty table, or one with no kept row, gives an empty one. Only the named columns
are read, others may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, trim

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose distances are held at a time.
BLOCK = 1024


def bound(dim: int) -> int:
    """Largest absolute component for which a vector's squared distance fits into 64 bits."""
    return math.isqrt((1 << 62) // max(1, dim)) // 2


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that count, and their components as integers."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # nulls become NaN
    good = np.isfinite(flat).all(axis=1)
    most = bound(dim)
    return rows[good], np.clip(np.floor(flat[good] * 256.0), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors (n, parts, width) and codebooks (parts, entries, width): the first nearest
    entry of each part, and its squared distance."""
    norms = (book * book).sum(axis=2)
    turned = book.transpose(0, 2, 1)
    codes, distances = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK].transpose(1, 0, 2)
        d = norms[:, None, :] - 2 * np.matmul(part, turned) + (part * part).sum(axis=2)[:, :, None]
        best = d.argmin(axis=2)
        codes[i : i + BLOCK] = best.T
        distances[i : i + BLOCK] = np.take_along_axis(d, best[:, :, None], 2)[:, :, 0].T
    return codes, distances


def start(df: DataFrame, key: str, vector: str, parts: int, entries: int) -> np.ndarray:
    """The first codebooks, (parts, entries, width). At most `entries` rows come to the driver."""
    x = F.col("v").cast("array<double>")
    named = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).select("id", x.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    named = named.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & fine)
    order = (F.col("id").asc_nulls_last(), "v")
    rows = named.orderBy(*order).limit(entries).collect()
    if len({len(r.v) for r in rows}) > 1:
        rows = named.where(F.size("v") == len(rows[0].v)).orderBy(*order).limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    _, found = integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), len(rows[0].v))
    return np.ascontiguousarray(found.reshape(len(found), parts, -1).transpose(1, 0, 2))


def improve(df: DataFrame, vector: str, book: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of the parts that choose it."""
    parts, entries, width = book.shape
    shared = df.sparkSession.sparkContext.broadcast(book)
    names = [f"s{k}" for k in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{n} long" for n in names)

    def sums(batches):
        book = shared.value
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            _, x = integers(b.column(0), parts * width)
            x = x.reshape(-1, parts, width)
            at = (nearest(x, book)[0] + np.arange(parts) * entries).ravel()
            flat = x.reshape(-1, width)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1])[: len(at)])
            if len(first):
                own = at[order][first]
                total[own] += np.add.reduceat(flat[order], first, axis=0)
                count += np.bincount(at, minlength=len(count))
        trim()
        used = np.flatnonzero(count)
        columns = [(used // entries).astype(np.int32), (used % entries).astype(np.int32), count[used], *total[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["part", "entry", "n", *names])

    wide = T.DecimalType(38, 0)
    merged = df.select(F.col(vector)).mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(n).cast(wide)).alias(n) for n in names])
    out = book.copy()
    for r in merged.collect():
        out[r.part, r.entry] = [int(r[n]) // r.n for n in names]
    return out


def codebooks(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Integer codebooks (parts, entries, width); (parts, 0, 0) where no row counts."""
    book = start(df, key, vector, parts, entries)
    for _ in range(rounds if book.shape[1] else 0):
        book = improve(df, vector, book)
    return book


def encode(df: DataFrame, book: np.ndarray, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The kept rows' columns `keep`, code (array of entry numbers, one a part) and error (sum of
    squared distances of the parts)."""
    parts, entries, width = book.shape
    shared = df.sparkSession.sparkContext.broadcast(book)
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def apply(batches):
        book = shared.value
        for b in batches:
            rows, x = integers(b.column(len(keep)), parts * width) if entries else (np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
            if len(rows):
                code, d = nearest(x.reshape(-1, parts, width), book)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts), pa.array(code.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(rows)) for k in range(len(keep))], lists, pa.array(d.sum(axis=1))], names=[*keep, "code", "error"])
        trim()

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").alias("_vector")).mapInArrow(apply, schema)


def decode(df: DataFrame, book: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    """df with the vector that a code stands for, in the integers' scale (null for null)."""
    shared = df.sparkSession.sparkContext.broadcast(book)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.ArrayType(T.LongType()))])

    def apply(batches):
        book = shared.value
        for b in batches:
            done = [None if c is None else book[np.arange(len(c)), c].ravel() for c in b.column(b.schema.get_field_index(code)).to_pylist()]
            keep = [n for n in b.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(done, pa.list_(pa.int64()))], names=[*keep, out])

    return df.mapInArrow(apply, schema)


def fingerprint(book: np.ndarray) -> str:
    """SHA-256 of all entries' components, in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: vec_id, code in hex (two digits a part for up to 256 entries), error,
    label_error (summed over equal labels, nulls together) and the codebooks' SHA-256."""
    df = df.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    book = codebooks(df, "vec_id", "embedding", parts, entries, rounds)
    coded = materialize(df.sparkSession, encode(df, book), "codes")
    digits = max(2, len(f"{max(1, entries) - 1:x}"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    text = F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", text.alias("code"), "error", "label_error", F.lit(fingerprint(book)).alias("codebooks_sha256"))
