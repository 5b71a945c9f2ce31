"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself
a vocabulary entry. Tier two: other pre-tokens are merged with a heap of adjacent pairs
over a doubly linked list of bytes, so a pre-token of n bytes costs O(n log n).

Nulls encode as empty texts; an empty text has no ids. Texts of any length work: pre-tokens
are found by one pass of the pattern, and memory is bounded by the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import trim

#: Distinct pre-tokens a worker remembers before it forgets all.
MEMO = 200_000


def load_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by id, from lines of base64 entry and rank."""
    pairs = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                entry, rank = line.split()
                pairs[int(rank)] = base64.b64decode(entry)
    return [pairs[i] for i in range(len(pairs))]


class PerfectHash:
    """Minimal perfect hash by bucket displacement: each of n/4 buckets stores the seed that
    sends its keys to free slots of a table of exactly n slots."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        groups: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            groups.setdefault(xxhash.xxh64_intdigest(k, 0) % self.buckets, []).append(i)
        self.seed = [0] * self.buckets
        self.slot = [-1] * n
        free = bytearray(b"\x01") * n
        for bucket, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            seed = 1
            while True:
                places = {xxhash.xxh64_intdigest(keys[i], seed) % n for i in members}
                if len(places) == len(members) and all(free[p] for p in places):
                    break
                seed += 1
            self.seed[bucket] = seed
            for i in members:
                p = xxhash.xxh64_intdigest(keys[i], seed) % n
                self.slot[p], free[p] = i, 0

    def candidate(self, key: bytes) -> int:
        """The only id that key can have; the caller compares the entry."""
        return self.slot[xxhash.xxh64_intdigest(key, self.seed[xxhash.xxh64_intdigest(key, 0) % self.buckets]) % self.n]


class Codec:
    def __init__(self, entries: list[bytes], pattern: str):
        self.entries, self.pattern = entries, pattern
        self.hash = PerfectHash(entries)
        self.ranks = {e: i for i, e in enumerate(entries)}
        self.split = None
        self.memo: dict[str, bytes] = {}

    def __getstate__(self):
        return {"entries": self.entries, "pattern": self.pattern, "hash": self.hash, "ranks": None, "split": None, "memo": {}}

    def rank(self, piece: bytes) -> int:
        """Id of a vocabulary entry, or -1."""
        i = self.hash.candidate(piece)
        return i if self.entries[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece outside the vocabulary: lowest rank first, leftmost among equals."""
        if self.ranks is None:
            self.ranks = {e: i for i, e in enumerate(self.entries)}
        rank, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        n = len(piece)
        end = list(range(1, n + 1))  # 0 where the part has been merged into its left neighbour
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = pop(heap)
            j = right[i]
            if end[i] != mid or j < 0 or end[j] != stop:
                continue  # one of the two has been merged since
            end[j], end[i] = 0, stop
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    push(heap, (r, i, stop, end[k]))
            h = left[i]
            if h >= 0 and (r := rank(piece[h:stop])) is not None:
                push(heap, (r, h, i, stop))
        ids, i = [], 0
        while i >= 0:
            ids.append(self.ranks[piece[i : end[i]]])
            i = right[i]
        return ids

    def piece_ids(self, piece: bytes) -> list[int]:
        i = self.rank(piece)
        return [i] if i >= 0 else self.merge(piece)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split is None:
            self.split = regex.compile(self.pattern).findall
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        pieces = self.split(text)
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            for p in set(pieces):
                if p not in memo:
                    memo[p] = np.array(self.piece_ids(p.encode()), dtype="<u4").tobytes()
            return b"".join([memo[p] for p in pieces])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


def codec_from(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def encode_documents(df: DataFrame, codec: Codec, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with an array<int> column of token ids of the whole text (empty for null)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(codec)
    out = T.StructType([*[f for f in df.schema.fields if f.name != ids], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def apply(batches):
        c = shared.value
        for b in batches:
            for part in _slices(b, text):
                coded = [np.frombuffer(c.encode_bytes(t or ""), dtype="<u4") for t in part.column(text).to_pylist()]
                flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                keep = [n for n in part.schema.names if n != ids]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], lists], names=[*keep, ids])

    return df.mapInArrow(apply, out)


def decode_ids(df: DataFrame, codec: Codec, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the decoded bytes."""
    shared = df.sparkSession.sparkContext.broadcast(codec.entries)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.BinaryType())])

    def apply(batches):
        entries = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                done = [b"".join(map(entries.__getitem__, x or ())) for x in part.column(ids).to_pylist()]
                keep = [n for n in part.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(done, pa.binary())], names=[*keep, out])

    return df.mapInArrow(apply, schema)


def _slices(batch: pa.RecordBatch, text: str, rows: int = 256):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
    trim()


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(df: DataFrame, codec: Codec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: how many ids, and SHA-256 of the ids and of the bytes they decode to."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def apply(batches):
        c = shared.value
        for b in batches:
            for part in _slices(b, text):
                n, coded, decoded = [], [], []
                for t in part.column(text).to_pylist():
                    raw = c.encode_bytes(t or "")
                    n.append(len(raw) // 4)
                    coded.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(np.frombuffer(raw, dtype="<u4").tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(apply, DIGEST)
