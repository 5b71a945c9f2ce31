"""BM25 weights of whole texts, by groups of texts.

A group has about GROUP_BYTES of text. Its words are numbered in the order of their spelling, so a
term (a word, or two adjacent ones as a_b) is a number in the group as well, and the numbers are
in the terms' order. A term goes once for each group that has it, as a 64-bit hash with the number
of the group's texts that have it, to the bucket of its hash, and the number of all texts comes
back. So neither terms nor their frequencies are shuffled or sorted as rows, and only the
heaviest terms of a text are spelled out. Terms are told apart by their hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import written

#: Bytes of text in a group; hashes in a bucket, about.
GROUP_BYTES, BUCKET = 4 << 20, 1_500_000
_U64 = np.uint64
#: All but [a-z0-9] separates words.
_SPACED = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for i in range(256))


class Numbers(dict):
    """Words by their first occurrence; -1 for those that do not count."""

    def __init__(self):
        super().__init__(dict.fromkeys((w.encode() for w in T.STOP_WORDS), -1))
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = -1
        if len(word) > 1:
            n = len(self.words)
            self.words.append(word)
        self[word] = n
        return n


def groups(df: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """A row for each group of texts: group, ids, sizes (counted words of each text), words (distinct,
    sorted), tokens (their numbers, text after text), length (terms of all texts) and sent: for
    each bucket, the group's hashes in order and how many texts have each."""
    kind = dict(df.dtypes)[key]

    def flush(number: int, ids: list, kept: list, numbers: Numbers) -> pa.RecordBatch:
        order = sorted(range(len(numbers.words)), key=numbers.words.__getitem__)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        tokens, sizes = rank[np.concatenate(kept)], np.array([len(x) for x in kept], np.int64)
        words = [numbers.words[i].decode() for i in order]
        g = Group(words, sizes, tokens)
        keys, counts = g.hashes(), np.bincount(g.term, minlength=len(g.first))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        edges = np.searchsorted(keys >> _U64(64 - bits), np.arange((1 << bits) + 1, dtype=_U64))
        some = [(n, i, j) for n, (i, j) in enumerate(zip(edges.tolist(), edges[1:].tolist())) if i < j]
        sent = pa.StructArray.from_arrays(
            [pa.array([n for n, *_ in some], pa.int64()), pa.array([packed(np.append(keys[i : i + 1], np.diff(keys[i:j]))) for _, i, j in some], pa.binary()), pa.array([packed(counts[i:j]) for _, i, j in some], pa.binary())], names=["bucket", "keys", "counts"]
        )
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), one(pa.concat_arrays(ids)), pa.array([sizes.tobytes()]), one(pa.array(words, pa.string())), pa.array([tokens.tobytes()]), pa.array([int(np.maximum(2 * sizes - 1, 0).sum())]), one(sent)],
            names=["group", "ids", "sizes", "words", "tokens", "length", "sent"],
        )

    def apply(batches):
        number, ids, kept, held, numbers = TaskContext.get().partitionId() << 33, [], [], 0, Numbers()
        for b in batches:
            low = 0
            for i, t in enumerate(b.column(1)):
                t = t.as_py() or ""
                n = np.fromiter(map(numbers.__getitem__, t.lower().encode().translate(_SPACED).split()), np.int64)
                kept.append(n[n >= 0])
                held += len(t)
                if held >= GROUP_BYTES:
                    yield flush(number, [*ids, b.column(0).slice(low, i + 1 - low)], kept, numbers)
                    number, ids, kept, held, low, numbers = number + 1, [], [], 0, i + 1, Numbers()
            ids.append(b.column(0).slice(low))
        if kept:
            yield flush(number, ids, kept, numbers)

    schema = f"group long, ids array<{kind}>, sizes binary, words array<string>, tokens binary, length long, sent array<struct<bucket:long,keys:binary,counts:binary>>"
    return df.select(F.col(key).alias("id"), text).mapInArrow(apply, schema)


class Group:
    """The terms of a group in their order: first and second word (-1: none); and of each text and
    term that it has, which they are and how often."""

    def __init__(self, words: list[str], sizes: np.ndarray, tokens: np.ndarray):
        self.words, self.sizes, v = words, sizes, len(words)
        # where a word stands among all words and beginnings "word_"
        begins = [w + "_" for w in words]
        at = np.empty(2 * v, np.int64)
        both = words + begins
        at[sorted(range(2 * v), key=both.__getitem__)] = np.arange(2 * v)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        tokens = tokens.astype(np.int64)
        near = np.flatnonzero(doc[1:] == doc[:-1])
        code = np.concatenate([at[tokens] * (v + 1), at[v + tokens[near]] * (v + 1) + 1 + tokens[near + 1]])
        number, values = pd.factorize(code)
        order = np.argsort(values)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first, second = np.divmod(values[order], max(1, v + 1))
        back = np.empty(2 * v, np.int64)
        back[at] = np.arange(2 * v)
        self.first, self.second = back[first] % max(1, v), second - 1
        held, self.tf = np.unique(np.concatenate([doc, doc[near]]) * max(1, len(order)) + rank[number], return_counts=True)
        self.doc, self.term = np.divmod(held, max(1, len(order)))

    @classmethod
    def of(cls, row: dict) -> Group:
        return cls(row["words"], np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["tokens"], np.int32))

    def hashes(self) -> np.ndarray:
        one = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in self.words), _U64)
        if not len(one):
            return one
        pair = mix(mix(one[self.first]) * _U64(0x9E3779B97F4A7C15) + one[self.second])
        return np.where(self.second < 0, one[self.first], pair)

    def spelled(self, terms: np.ndarray) -> pa.Array:
        words = pa.array(self.words, pa.string())
        second = self.second[terms]
        pairs = pa.compute.binary_join_element_wise(words.take(pa.array(self.first[terms])), words.take(pa.array(second, mask=second < 0)), "_")
        return pa.compute.if_else(pa.array(second < 0), words.take(pa.array(self.first[terms])), pairs)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


def packed(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    x = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1)


def document_counts(grouped: DataFrame) -> DataFrame:
    """group, bucket, counts: for the group's hashes of a bucket, in their order, how many texts of
    all groups have each."""

    def meet(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(k).view(_U64), dtype=_U64) for k in t.column("keys").to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every)
        fresh = np.append(True, np.diff(every[order]) != 0)
        total = np.add.reduceat(np.concatenate([unpacked(c) for c in t.column("counts").to_pylist()])[order], np.flatnonzero(fresh))
        out = np.empty(len(order), np.int64)
        out[order] = total[np.cumsum(fresh) - 1]
        ends = np.cumsum([0, *map(len, keys)])
        return pa.table({"group": t.column("group"), "bucket": t.column("bucket"), "counts": pa.array([packed(out[i:j]) for i, j in zip(ends, ends[1:])], pa.binary())})

    sent = grouped.select("group", F.inline("sent")).select("bucket", "group", "keys", "counts")
    return sent.groupBy("bucket").applyInArrow(meet, "group long, bucket long, counts binary")


def bm25(df: DataFrame, key: str, text: str, top: int, k1: float, b: float) -> DataFrame:
    """id, term, weight: each text's heaviest terms, weights rounded to six digits."""
    kind = dict(df.dtypes)[key]
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    # a group has about a hash for every eight bytes
    bits = max(1, int(np.ceil(np.log2(max(1, size / 8 / BUCKET)))))
    grouped = written(groups(df, key, text, bits), "text-groups")
    n, total = grouped.agg(F.sum(F.size("ids").cast("long")), F.sum("length")).first()
    schema = f"id {kind}, term string, weight double"
    if not total:
        return df.sparkSession.createDataFrame([], schema)
    mean = max(total / n, 1.0)

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["words", "sizes", "tokens"]).to_pylist()[0]
        g, ids = Group.of(row), left.column("ids").combine_chunks().flatten()
        counts = np.empty(len(g.first))
        back = right.select(["bucket", "counts"]).to_pylist()
        if back:
            counts[np.argsort(g.hashes())] = np.concatenate([unpacked(r["counts"]) for r in sorted(back, key=lambda r: r["bucket"])])
        length = 2 * g.sizes - 1
        norm = k1 * (1 - b + b * length / mean)
        idf = np.log(1.0 + (n - counts + 0.5) / (counts + 0.5))
        weight = idf[g.term] * (g.tf * (k1 + 1)) / (g.tf + norm[g.doc])
        units = np.floor(weight * 1e6 + 0.5).astype(np.int64)
        # by weight, then by term: that is how they stand
        order = np.argsort((g.doc << 32) - units, kind="stable")
        first = np.searchsorted(g.doc, np.arange(len(g.sizes)))
        own = order[(np.arange(len(order)) - first[g.doc] < top) & (units[order] > 0)]
        return pa.table({"id": ids.take(pa.array(g.doc[own])), "term": g.spelled(g.term[own]), "weight": weight[own]})

    back = document_counts(grouped)
    found = grouped.select("group", "ids", "sizes", "words", "tokens").groupBy("group").cogroup(back.groupBy("group")).applyInArrow(weigh, schema).withColumn("weight", F.round("weight", 6))
    if not grouped.select(F.explode("ids").alias("id")).groupBy("id").count().where("count > 1").isEmpty():  # rows of one id share their heaviest
        w = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
        found = found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).drop("_rn")
    return found
