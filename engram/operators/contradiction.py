"""Pairs of texts about one thing, and whether they contradict.

A text is the set of its content tokens, as keys: a token's hash, or the number of a frequent one.
Tasks read texts and count; neither tokens nor pairs are shuffled as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .lexical import _SPACED, packed, unpacked
from .retrieval import MANY_QUERIES, _matrix
from .storage import written


#: Texts of one side of a task that compares all pairs, and pairs of texts it counts at a time.
GROUP, CELLS = 32_768, 1 << 21
#: A token in more than one of so many pairs is counted by a product of matrices.
COMMON = 200
#: Frequent tokens that travel as small numbers; tokens that a task remembers, keys it counts at a time.
LISTED, MEMO, HELD = 1 << 20, 1 << 18, 1 << 22
#: Texts of a batch that are taken at a time, and bytes of stated texts.
ROWS, ASKED_BYTES = 4096, 64 << 20


class Keys(dict):
    """Tokens by a 62-bit hash; 0 for those that do not count."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        if not self:
            self.update(dict.fromkeys((w.encode() for w in T.STOP_WORDS), 0))
            if word in self:
                return 0
        key = self[word] = (int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big") >> 2) | 1 << 62
        return key

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each text's distinct tokens, text after text, and how many each has."""
        found, size = [np.zeros(0, np.int64)], []
        for t in texts:
            words = set((t.as_py() or "").lower().encode().translate(_SPACED).split())
            k = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            k = k[k > 0]
            found.append(k)
            size.append(len(k))
        return np.concatenate(found), np.array(size, np.int64)


class Sets:
    """Sets that others are compared with. Tokens of many pairs are rows of a matrix, the others are
    found by their postings."""

    def __init__(self, keys: np.ndarray, size: np.ndarray):
        self.names, code = np.unique(keys, return_inverse=True)
        held, row, self.n = np.bincount(code, minlength=len(self.names)), np.repeat(np.arange(len(size)), size), len(size)
        many = held.astype(float) ** 2 * COMMON > float(self.n) ** 2
        self.column = np.where(many, np.cumsum(many) - 1, -1)
        self.dense = np.zeros((int(many.sum()), self.n), np.float32)
        own = many[code]
        self.dense[self.column[code[own]], row[own]] = 1
        code, row = code[~own], row[~own]
        order = np.argsort(code, kind="stable")
        self.posts = np.split(row[order], np.searchsorted(code[order], np.arange(1, len(self.names))))

    def common(self, keys: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """How many tokens texts have in common with each set: number of a block's first text and
        a row for each text."""
        row = np.repeat(np.arange(len(size)), size)
        at = np.searchsorted(self.names, keys)
        at[at == len(self.names)] = 0
        met = self.names[at] == keys if len(self.names) else np.zeros(len(keys), bool)
        code, row = at[met], row[met]
        column = self.column[code]
        many = column >= 0
        few, ends = code[~many], np.searchsorted(row[~many], np.arange(len(size) + 1))
        column, who = column[many], row[many]
        step = max(1, CELLS // max(1, self.n))
        for i in range(0, len(size), step):
            x = np.zeros((min(step, len(size) - i), len(self.dense)), np.float32)
            lo, hi = np.searchsorted(who, [i, i + step])
            x[who[lo:hi] - i, column[lo:hi]] = 1
            s = x @ self.dense
            for j in range(len(s)):
                own = few[ends[i + j] : ends[i + j + 1]].tolist()
                if own:
                    s[j] += np.bincount(np.concatenate([self.posts[t] for t in own]), minlength=self.n)
            yield i, s


def _need(n: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """How many common tokens a pair needs whose smaller set has n."""
    return np.maximum(least, np.ceil(threshold * n)).astype(np.float32)


def _frequent(docs: DataFrame, least: int) -> tuple[int, np.ndarray, np.ndarray, bool]:
    """How many texts have at least some tokens; keys of the tokens that most texts have, sorted, and their
    numbers; and whether all other tokens are in one text only."""

    def count(batches):
        memo, texts, held = Keys(), 0, []

        def added():
            key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in held)]), return_inverse=True)
            return [(key, np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in held)]), len(key)))]

        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                keys, size = memo.sets(b.column(0).slice(i, ROWS))
                texts += int((size >= least).sum())
                held.append((keys, np.ones(len(keys))))
                if sum(len(k) for k, _ in held) > HELD:
                    held = added()
                    if len(held[0][0]) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1].astype(np.int64))], names=["key", "n"])
                        held = []
        held = added()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held[0][0], 0)), pa.array(np.append(held[0][1], texts).astype(np.int64))], names=["key", "n"])

    counts = written(docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1 or key = 0"), "token-counts")
    texts = counts.where("key = 0").agg(F.sum("n")).first()[0] or 0
    counts = counts.where("key <> 0")
    bound, total, whole = 2, 0, True
    for n, words in sorted((tuple(r) for r in counts.groupBy("n").count().collect()), reverse=True):
        if total + words > LISTED:
            bound, whole = n + 1, False
            break
        total += words
    top = counts.where(F.col("n") >= bound).toArrow()
    key, n = (top.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(key)
    number = np.empty(len(key), np.int64)
    number[np.lexsort((key, -n))] = np.arange(len(key))
    return texts, key[order], number[order], whole


def related_pairs(docs: DataFrame, threshold: float = 0.45, least: int = 1, asked: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """a < b, overlap: overlap coefficient of content tokens at or above the threshold, with at
    least some tokens in common. asked: ids one of which has to be in the pair; digits: the overlap is
    rounded, half up. All pairs are looked at, which is quadratic: texts, as packed numbers of their
    tokens, are dealt to groups, and a task counts what two groups have in common a part at a time and
    puts out only pairs that pass."""
    least = max(1, least)
    spark, kind = docs.sparkSession, dict(docs.dtypes)["id"]
    texts, key, number, whole = _frequent(docs, least)
    groups = max(-(-texts // GROUP), min(8, -(-texts // 1024)), 1)
    rows = docs.select("id", "text", F.lit(True).alias("own")) if asked is None else docs.select("id", "text").join(asked.select("id").distinct().withColumn("own", F.lit(True)), "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    shared = spark.sparkContext.broadcast((key, number))

    def pack(batches):
        key, number = shared.value
        memo = Keys()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                keys, n = memo.sets(part.column(1))
                row = np.repeat(np.arange(len(n)), n)
                at = np.searchsorted(key, keys)
                at[at == len(key)] = 0
                known = key[at] == keys if len(key) else np.zeros(len(keys), bool)
                keys[known] = number[at[known]]
                kept = (n >= least)[row] & (known | (not whole))
                keys, row = keys[kept], row[kept]
                size, group = np.bincount(row, minlength=len(n)), part.column(3).to_numpy()
                order = np.lexsort((keys, row, group[row]))
                keys, row = keys[order], row[order]
                for g in np.unique(group[size > 0]).tolist():
                    own = np.flatnonzero((group == g) & (size > 0))
                    lo, hi = np.searchsorted(group[row], [g, g + 1])
                    k = keys[lo:hi]
                    ids = part.column(0).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids), *(pa.array([x.astype(np.int32).tobytes()]) for x in (n[own], part.column(2).to_numpy(zero_copy_only=False)[own], size[own])), pa.array([packed(np.append(k[:1], np.diff(k)))])],
                        names=["_g", "ids", "n", "own", "size", "keys"],
                    )

    sets = rows.select("id", "text", "own", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("_g"))
    sets = written(sets.mapInArrow(pack, f"_g int, ids array<{kind}>, n binary, own binary, size binary, keys binary"), "token-sets")
    dealt = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_o"))
    x, y = F.least("_g", "_o"), F.greatest("_g", "_o")
    dealt = dealt.select((x * groups + y).alias("_p"), "ids", "n", "own", "size", "keys", (F.col("_g") <= F.col("_o")).alias("_left"), (F.col("_g") >= F.col("_o")).alias("_right"))
    found = dealt.repartitionByRange(groups * (groups + 1) // 2, "_p").groupBy("_p").applyInArrow(_counter(threshold, least, digits), f"a {kind}, b {kind}, overlap double")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap")


def _counter(threshold: float, least: int, digits: int | None):
    """Pairs of a group's left and right texts, one of them asked for. Both sides are the same where both flags are set."""

    def opened(r: dict) -> tuple[np.ndarray, ...]:
        return (np.cumsum(unpacked(r["keys"])), *(np.frombuffer(r[c], np.int32).astype(np.int64) for c in ("size", "n", "own")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        left, right = (np.flatnonzero(held.column(c).to_numpy()) for c in ("_left", "_right"))
        if not len(left) or not len(right):
            return
        ids = held.column("ids").combine_chunks()
        rows = held.select(["size", "n", "own", "keys"]).to_pylist()
        parts = [opened(rows[i]) for i in right.tolist()]
        names = ids.take(pa.array(right)).flatten()
        n, asked = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        sets, need = Sets(*(np.concatenate([p[i] for p in parts]) for i in (0, 1))), _need(n, threshold, least)
        del parts
        # where a left part begins among the right texts, if it is one of them
        first = dict(zip(right.tolist(), np.cumsum([0, *(len(rows[i]["n"]) // 4 for i in right.tolist())]).tolist()))
        for i in left.tolist():
            keys, size, m, own = opened(rows[i])
            mine, enough = ids.slice(i, 1).flatten(), _need(m, threshold, least)
            for low, s in sets.common(keys, size):
                p, q, c = [], [], []
                for j in range(len(s)):
                    at = np.flatnonzero(s[j] >= np.minimum(need, enough[low + j]))
                    if i in first:
                        at = at[at > first[i] + low + j]
                    if not own[low + j]:
                        at = at[asked[at] > 0]
                    p.append(np.full(len(at), low + j))
                    q.append(at)
                    c.append(s[j, at])
                p, q, c = np.concatenate(p), np.concatenate(q), np.concatenate(c).astype(np.int64)
                less = np.minimum(m[p], n[q])
                overlap = c / less if digits is None else (2 * 10**digits * c + less) // (2 * less) / 10**digits
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(p)), names.take(pa.array(q)), pa.array(overlap)], names=["a", "b", "overlap"])

    return count


def contradictions(points: DataFrame, threshold: float = 0.45) -> DataFrame:
    """older, newer, similarity, signals of texts related by their words whose polarity differs;
    superseded points do not take part. points: id, text, created_at, superseded_by."""
    live = points.where("superseded_by is null")
    return _opposed(related_pairs(live.select("id", "text"), threshold).withColumnRenamed("overlap", "similarity"), live)


#: What two texts can say against one another: a bit each.
SIGNALS = ("negation_flip", *(f"antonym:{x}/{y}" for x, y in T.ANTONYMS))


def _across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SIGNALS of texts whose polarity is a and b, as bits."""
    out = (a ^ b) & 1
    for i in range(len(T.ANTONYMS)):
        x, y = 1 + 2 * i, 2 + 2 * i
        out |= ((((a >> x) & (b >> y)) | ((a >> y) & (b >> x))) & 1) << (1 + i)
    return out


def check(asked: DataFrame, points: DataFrame, threshold: float = 0.45, least: int = 1) -> DataFrame:
    """contradictions() of a stated set of points (id and q, the point's vector, and in points as well)
    with all others, related by the greater of cosine and overlap. The stated points are broadcast in
    blocks, a task compares each text with all of a block by words, vectors and what they say, and puts
    out what contradicts: no pair is shuffled. points: id, text, dense (unit vectors), created_at,
    superseded_by."""
    least, spark, kind = max(1, least), points.sparkSession, dict(points.dtypes)["id"]
    each = T.polarity(F.col("text"))
    said = sum((F.when(F.get(each, F.lit(i)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(1, 1 + 2 * len(T.ANTONYMS))), F.get(each, F.lit(0)).cast("int")).cast("long").alias("said")
    live = points.where("superseded_by is null and text is not null")
    rows = live.select("id", "text", said, F.col("created_at").cast("double").alias("at"), V.doubles(F.col("dense")).alias("vec"))

    def keyed(batches):
        memo = Keys()
        for b in batches:
            keys, size = memo.sets(b.column(1))
            parts = np.split(keys, np.cumsum(size)[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in (2, 3, 4)), pa.array([k.tobytes() for k in parts], pa.binary())], names=["id", "said", "at", "vec", "keys"])

    own = live.join(F.broadcast(asked.select("id", V.doubles(F.col("q")).alias("vec"))), "id").select("id", "text", said, F.col("created_at").cast("double").alias("at"), "vec")
    own = written(own.mapInArrow(keyed, f"id {kind}, said long, at double, vec array<double>, keys binary"), "asked-sets")
    n, size = own.agg(F.count("*"), F.sum(F.octet_length("keys").cast("long"))).first()
    blocks = max(1, -(-n // MANY_QUERIES), -(-(size or 0) // ASKED_BYTES))
    every = own.select("id").toArrow().column(0).combine_chunks()
    out = None
    for i in range(blocks):
        block = (own if blocks == 1 else own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((every, block))
        found = rows.mapInArrow(_comparer(shared, threshold, least), f"q {kind}, id {kind}, first boolean, similarity double, bits long")
        out = found if out is None else out.union(found)
    signals = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(SIGNALS)]))
    return out.select(F.when(F.col("first"), F.col("q")).otherwise(F.col("id")).alias("older"), F.when(F.col("first"), F.col("id")).otherwise(F.col("q")).alias("newer"), "similarity", signals.alias("signals"))


def _comparer(shared, threshold: float, least: int):
    """Texts (id, text, said, at, vec) against a block of stated points."""

    def compare(batches):
        every, block = shared.value
        ids, said, at, vec, keys = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in block.columns)
        raw = keys.to_pylist()
        n = np.array([len(k) // 8 for k in raw], np.int64)
        sets, need = Sets(np.frombuffer(b"".join(raw), np.int64), n), _need(n, threshold, least)
        del raw
        pointed = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
        q = _matrix(vec.drop_null()).T
        says, what = np.unique(said.to_numpy(), return_inverse=True)
        at, memo = at.to_numpy(zero_copy_only=False), Keys()
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                k, m = memo.sets(part.column(1))
                enough, mine = _need(m, threshold, least), part.column(2).to_numpy()
                told = np.flatnonzero(part.column(4).is_valid().to_numpy(zero_copy_only=False)) if len(pointed) else np.zeros(0, int)
                v = _matrix(part.column(4).drop_null()) if len(told) else None
                for low, s in sets.common(k, m):
                    lo, hi = np.searchsorted(told, [low, low + len(s)])
                    near = v[lo:hi] @ q if hi > lo else None
                    who, row, alike, bits = [], [], [], []
                    for j in range(len(s)):
                        words = s[j] >= np.minimum(need, enough[low + j])
                        cosine = None
                        if lo < hi and told[lo] == low + j:
                            cosine = np.full(len(n), -np.inf)
                            cosine[pointed] = near[len(near) - (hi - lo)]
                            lo += 1
                        own = np.flatnonzero(words if cosine is None else words | (cosine >= threshold))
                        signals = _across(says, mine[low + j])[what[own]]
                        own, signals = own[signals > 0], signals[signals > 0]
                        score = np.where(words[own], s[j, own].astype(float) / np.maximum(1, np.minimum(m[low + j], n[own])), -np.inf)
                        who.append(own)
                        row.append(np.full(len(own), low + j))
                        alike.append(score if cosine is None else np.maximum(score, cosine[own]))
                        bits.append(signals)
                    who, row, alike, bits = (np.concatenate(x) for x in (who, row, alike, bits))
                    x, y = ids.take(pa.array(who)), part.column(0).take(pa.array(row))
                    before = pa.compute.less(x, y).to_numpy(zero_copy_only=False)
                    # a pair of two stated points is met from either side
                    both = pa.compute.is_in(part.column(0), every).to_numpy(zero_copy_only=False)[row]
                    kept = pa.compute.not_equal(x, y).to_numpy(zero_copy_only=False) & (before | ~both)
                    a, c = at[who], part.column(3).to_numpy(zero_copy_only=False)[row]
                    first = np.where(before, a <= c, ~(c <= a))
                    yield pa.RecordBatch.from_arrays([x, y, pa.array(first), pa.array(alike), pa.array(bits)], names=["q", "id", "first", "similarity", "bits"]).filter(pa.array(kept))

    return compare


def _opposed(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """What a text says is told from it once: pairs meet a few truths, not texts."""
    said = written(live.select("id", "created_at", T.polarity(F.col("text")).alias("said")), "polarity")
    x, y = (said.select(F.col("id").alias(i), F.col("said").alias(f"s{i}"), F.col("created_at").alias(f"c{i}")) for i in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("signals", T.opposed(F.col("sa"), F.col("sb"))).where(F.size("signals") > 0)
    first = F.col("ca") <= F.col("cb")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("newer"), "similarity", "signals")
