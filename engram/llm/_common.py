"""What the training-data operators share: shared-folder tables, text hashing, Arrow batches.

Intermediate tables go to the folder the session names in ``spark.checkpoint.dir``; a local
folder takes its place only where that setting is absent and the master is local (tests).
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text hashed at a time; bounds the size of temporary arrays.
CHUNK_BYTES = 1 << 20


# --------------------------------------------------------------------- tables


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set to a local one only where the session has none and
    all runs in one JVM."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes share (master is {master})")
        found = tempfile.mkdtemp(prefix="engram-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost
    executor costs a re-read and not a recomputation."""
    release(spark)  # of what the caller has let go since the last table
    path = f"{shared_dir(spark)}/engram/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more, also not a result yet to be computed."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def smallest(df: DataFrame, by, k: int, *ties) -> DataFrame:
    """The k rows with the smallest hash. The hash tells about where the k-th lies, so that only
    about 2 * k rows are ordered, whatever the number of rows and tasks."""
    n = df.count()
    if n > 4 * k:
        bound = -(1 << 63) + int((1 << 64) * (2.0 * k / n))
        near = df.where(by <= F.lit(bound).cast("long"))
        if near.count() >= k:
            df = near
    return df.orderBy(by, *ties).limit(k)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column, counted: an optimizer's estimate of a join or of local rows can be
    larger by any factor."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


# ----------------------------------------------------------------- text arrays


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0xD1342543DE82EF95)
LANES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones((2, 1), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**n modulo 2**64, and in the second row their inverses."""
    global _powers
    if _powers.shape[1] <= n:
        size = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        steps = np.ones((2, size), dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = _BASE, _INVERSE
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


#: Bytes of words: white space 0x20 and 0x09-0x0D separates.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words after lower-casing: digits, letters, everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if buffers[1] is not None and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    low, high = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    return data[low:high], offsets - low


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None


def trim() -> None:
    """Gives freed memory back: workers live on, and their next task should start small."""
    if _libc is not None:
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last+1) row ranges of at most limit bytes, or one long row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
    trim()


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of its first word (n+1 values)."""
    inside = kind[data]
    before = np.empty_like(inside)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of data[start:end]; fold: letters A-Z count as a-z."""
    n = len(data)
    p, inverse = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * p[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i; rows are not looked at."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += words[j : j + n] * LANES[j]
    return mix(total + U64(k))


def whole_hash(words: np.ndarray) -> np.uint64:
    """Hash of one word sequence; for fewer than len(LANES) words equal to gram_hashes(words, len(words))[0]."""
    n = len(words)
    lanes = LANES[:n] if n <= len(LANES) else np.resize(LANES, n) * (np.arange(n, dtype=np.uint64) * U64(2) + U64(1))
    return mix(np.array([np.sum(words * lanes, dtype=np.uint64) + U64(n)], dtype=np.uint64))[0]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in ((f.name, columns[f.name]) for f in schema)], schema=schema)
