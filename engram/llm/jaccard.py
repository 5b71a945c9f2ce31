"""N-gram Jaccard join by universe-partition pigeonhole.

A document is its set of distinct 5-word shingles. In a band of set sizes the shingle universe
is hashed into so many segments that two sets of Jaccard similarity >= 3/4 cannot differ in
all: their difference has at most H elements, and a set has more than H non-empty segments.
Each segment's subset is a signature; documents that share one are candidates.

Cost-based allocation. Small bands have few elements, so there every segment also emits its
one-deletion neighbourhood, which makes it count for two of the H + 1 units needed at the cost
of one signature an element. Large bands use exact subsets in about a third more segments than
needed. The units left over (slack) are spent on frequent signatures: a pair is looked for in
runs of more than HOT documents only if both documents miss too many units without them
("needy"). By the same count a pair must share slack + 1 - (frequent signatures) subsets of a
large band, or it cannot be similar; this drops chance candidates before verification.
Documents whose units do not suffice also emit signatures of their empty segments, with which
all segments are covered.

Candidates are verified exactly on their shingle sets. Needy documents are first verified
against one central member of a part of their frequent runs, which joins most families. All
needy documents in different components are then joined by prefix filter: with shingles in
one order, the rare first, a pair with enough in common shares one among the first few of
both. So nothing depends on the runs chosen, and no group is compared in all pairs. Documents
with equal sets collapse to one before all this, in each task and by fingerprint.

Signatures travel as arrays by bucket, a row for each batch and bucket; the number of buckets
follows the size of the input. Only signatures of one band can be equal, so a bucket belongs to a
band and a set goes to few of them: each of them is told its fingerprint.

Defined results: null, empty and word-less texts have no shingles and are their own
component; rows with one doc_id are one document; a null doc_id has a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LANES, SPACED, U64, chunks, gram_hashes, materialize, mix, partitions_for, span_hashes, text_buffer, trim, whole_hash, word_spans
from .components import components

SHINGLE = 5
#: A pair links when NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
RATIO, SMALL, SPARE, HOT = 1.75, 48, 1.35, 16
#: One frequent run in so many gives candidates with its central member.
STAR_RUNS = 4
#: Signatures held before they are sent, and bytes of text for one bucket.
FLUSH, BUCKET_BYTES = 4_000_000, 10 << 20


def _bands() -> tuple[np.ndarray, np.ndarray]:
    """Largest set size of each band, and its number of segments."""
    high, low = [], 1
    while low < 1 << 40:
        high.append(max(low, int(RATIO * low)))
        low = high[-1] + 1
    hi = np.array(high)
    bound = difference(hi, hi * 4 // 3)
    return hi, np.where(hi <= SMALL, np.maximum(1, np.ceil(0.8 * (bound + 1))), np.ceil(SPARE * (bound + 1))).astype(np.int64)


def difference(n, m):
    """Largest symmetric difference of sets of n and m elements with similarity >= 3/4."""
    return (n + m) // 7


HI, SEGMENTS = _bands()


# ------------------------------------------------------------------------ sets


def shingle_sets(column: pa.Array):
    """(first row, last row + 1, sorted distinct shingle hashes of each) by chunk."""
    data, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        low = int(offsets[i])
        starts, ends, first = word_spans(part := data[low : int(offsets[j])], offsets[i : j + 1] - low, SPACED)
        words = span_hashes(part, starts, ends)
        grams = gram_hashes(words, SHINGLE)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            else:
                out.append(np.array([whole_hash(words[a:b])], dtype=np.uint64) if b > a else np.zeros(0, np.uint64))
        yield i, j, out


def fingerprints(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Equal for equal sets; the mix of both sums is taken over all elements."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    edges = np.concatenate([[0], np.cumsum(n)])
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat + LANES[20]), out=sums[1:])
    return mix(sums[edges[1:]] - sums[edges[:-1]] + n.astype(np.uint64) * LANES[21])


def signatures(flat: np.ndarray, n: np.ndarray, band: np.ndarray, bound: np.ndarray):
    """Signatures of sets (their elements laid end to end) in the partitions of their bands,
    the number of the set of each, and the sets' units beyond bound + 1."""
    m = SEGMENTS[band]
    owner = np.repeat(np.arange(len(n)), n)
    token, salt = mix(flat ^ LANES[22]), mix(band.astype(np.uint64) + LANES[23])
    first = np.concatenate([[0], np.cumsum(m)])
    total = int(first[-1])
    at = first[owner] + (mix(flat + salt[owner]) % m[owner].astype(np.uint64)).astype(np.int64)
    # sums modulo 2**64 by halves, each exact in a float
    low = np.bincount(at, weights=(token & U64(0xFFFFFFFF)).astype(float), minlength=total).astype(np.uint64)
    sums = low + (np.bincount(at, weights=(token >> U64(32)).astype(float), minlength=total).astype(np.uint64) << U64(32))
    count = np.bincount(at, minlength=total)
    seg_owner = np.repeat(np.arange(len(n)), m)
    tag = mix((np.arange(total) - first[seg_owner]).astype(np.uint64) * LANES[24] + salt[seg_owner])
    small = HI[band] <= SMALL
    double = small[seg_owner] & (count > 1)
    units = np.bincount(seg_owner, weights=(count > 0) + 1.0 * double, minlength=len(n)).astype(np.int64)
    slack = units - (bound + 1)
    poor = slack < 0

    def signature(s, c, t):
        return mix(s + c.astype(np.uint64) * LANES[25] + t)

    own = (count > 0) | poor[seg_owner]
    sig, who = [signature(sums, count, tag)[own]], [seg_owner[own]]
    # one deletion: from subsets of two and more, from single elements too where units are short
    out = small[owner] & ((count[at] > 1) | poor[owner])
    sig.append(signature(sums[at[out]] - token[out], count[at[out]] - 1, tag[at[out]]))
    who.append(owner[out])
    return np.concatenate(sig), np.concatenate(who), slack


#: A set with some of its signatures in a bucket, at most MOST.
_ENTRY = np.dtype([("fp", "<u8"), ("n", "<u4"), ("slack", "<i2"), ("band", "u1"), ("count", "u1")])
MOST = 255
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("fp", "<u8"), ("n", "<u4")])


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, last + 1) of each run of equal values."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return list(zip(x[first].tolist(), first.tolist(), [*first[1:].tolist(), len(x)]))


class Sender:
    """Gathers signatures of a task and lays them out by bucket."""

    def __init__(self, share: np.ndarray):
        """share: number of buckets of each band."""
        self.share, self.first, self.buckets, self.seen = share.astype(np.uint64), np.cumsum(share) - share, int(share.sum()), set()
        self.clear()

    def clear(self) -> None:
        self.entries, self.sigs, self.who, self.docs, self.held, self.known = [], [], [], [], 0, 0

    def add(self, ids, nulls, sets: list[np.ndarray]) -> None:
        n = np.array([len(s) for s in sets], dtype=np.int64)
        fp = fingerprints(sets, n)
        docs = np.zeros(len(n), _DOC)
        docs["id"], docs["null"], docs["fp"], docs["n"] = ids, nulls, fp, n
        self.docs.append(docs)
        if len(self.seen) > 2_000_000:
            self.seen.clear()
        fresh = []
        for r in np.flatnonzero(n).tolist():
            if (f := int(fp[r])) not in self.seen:
                self.seen.add(f)
                fresh.append(r)
        fresh = np.array(fresh, dtype=np.int64)
        band = np.searchsorted(HI, n)
        lower = fresh[(band[fresh] > 0) & (3 * n[fresh] <= 4 * HI[np.maximum(band[fresh] - 1, 0)])]
        for rows, own in ((fresh, band[fresh]), (lower, band[lower] - 1)):
            some = difference(HI[own], HI[own] * 4 // 3) > 0  # else only equal sets are similar
            rows, own = rows[some], own[some]
            if not len(rows):
                continue
            # partners: up to 4/3 as large in the set's own band, up to the band's end in the one below
            bound = difference(n[rows], np.where(own == band[rows], n[rows] * 4 // 3, HI[own]))
            sig, who, slack = signatures(np.concatenate([sets[r] for r in rows]), n[rows], own, bound)
            entry = np.zeros(len(rows), _ENTRY)
            entry["fp"], entry["n"], entry["slack"], entry["band"] = fp[rows], n[rows], np.clip(slack, -(1 << 15), (1 << 15) - 1), own
            self.entries.append(entry), self.sigs.append(sig), self.who.append(who + self.known)
            self.known += len(rows)
            self.held += len(sig)

    def batches(self):
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, _DOC)
        where = (docs["fp"] % U64(self.buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        rows = [[], [], [], []]
        for k, a, b in runs(where[order]):
            for r, x in zip(rows, (k, docs[order[a:b]].tobytes(), b"", b"")):
                r.append(x)
        if self.sigs:
            entries, sig, who = np.concatenate(self.entries), np.concatenate(self.sigs), np.concatenate(self.who)
            band = entries["band"][who]
            bucket = self.first[band] + (sig % self.share[band]).astype(np.int64)
            del band
            bucket = bucket.astype(np.uint16) if self.buckets < 1 << 16 else bucket.astype(np.int64)
            order = np.lexsort((who, bucket)) if self.buckets >= 1 << 16 else np.argsort(who, kind="stable")[np.argsort(bucket[np.argsort(who, kind="stable")], kind="stable")]
            bucket, sig, who = bucket[order], sig[order], who[order]
            for k, a, b in runs(bucket):
                place = np.arange(b - a)
                start = np.maximum.accumulate(np.where(np.append(True, who[a + 1 : b] != who[a : b - 1]), place, 0))
                heads = np.flatnonzero((place - start) % MOST == 0)
                part = entries[who[a:b][heads]]
                part["count"] = np.diff(np.append(heads, b - a))
                high = sig[a:b] >> U64(24)  # what chance makes equal is verified
                for r, x in zip(rows, (k, b"", part.tobytes(), (high >> U64(8)).astype("<u4").tobytes() + (high & U64(0xFF)).astype("u1").tobytes())):
                    r.append(x)
        self.clear()
        for i in range(0, len(rows[0]), 64):
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][i : i + 64], pa.int32()), *[pa.array(r[i : i + 64], pa.binary()) for r in rows[1:]]], names=["bucket", "docs", "entries", "sigs"])


_FOUND = "kind int, a long, b long, band int, x long, y long, na long, nb long"
_NAMES = ["kind", "a", "b", "band", "x", "y", "na", "nb"]


def _emit(kind: int, n: int, **columns) -> pa.Table:
    arrays = [pa.array(np.full(n, kind, np.int32))]
    for k in _NAMES[1:]:
        t = pa.int32() if k == "band" else pa.int64()
        v = columns.get(k)
        arrays.append(pa.nulls(n, t) if v is None else v if isinstance(v, pa.Array) else pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int32 if k == "band" else np.int64)))
    return pa.Table.from_arrays(arrays, names=_NAMES)


def meet(table: pa.Table) -> pa.Table:
    """What one bucket shows. Kind 0: a document (a id, b fingerprint, x set size). Kind 1: a
    pair of sets (a, b) with x shared signatures of a band, their slack in y as two halves and
    their sizes. Kind 2: a set (a) with the number y of its frequent signatures of a band, its slack
    x and size na. Kind 3: a set (a) in a chosen frequent run (b), with its size na."""
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), _DOC)
    out = [_emit(0, len(docs), a=pa.array(docs["id"].copy(), mask=docs["null"].astype(bool)), b=docs["fp"].copy(), x=docs["n"].copy())]
    entries, sigs = [], []
    for e, s in zip(table.column("entries").to_pylist(), table.column("sigs").to_pylist()):
        if e:
            entries.append(np.frombuffer(e, _ENTRY))
            k = len(s) // 5
            sigs.append((np.frombuffer(s, "<u4", k).astype(np.uint64) << U64(8)) | np.frombuffer(s, "u1", k, 4 * k).astype(np.uint64))
    if entries:
        entry, sig = np.concatenate(entries), np.concatenate(sigs)
        del entries, sigs
        who = np.repeat(np.arange(len(entry), dtype=np.int32), entry["count"])
        order = np.argsort(sig, kind="stable")
        sig, who = sig[order], who[order]
        twice = np.zeros(len(sig), bool)
        twice[1:] = sig[1:] == sig[:-1]
        twice[:-1] |= twice[1:]
        sig, who = sig[twice], who[twice]
        fp = entry["fp"][who]
        order = np.lexsort((fp, sig))
        sig, who, fp = sig[order], who[order], fp[order]
        one = np.append(True, (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1]))[: len(sig)]
        sig, who, fp = sig[one], who[one], fp[one]
        heads = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        size = np.diff(np.append(heads, len(sig)))
        left, right = [], []
        for g in range(2, HOT + 1):
            at = heads[size == g]
            for i in range(g - 1):
                for j in range(i + 1, g):
                    left.append(at + i), right.append(at + j)
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        n = entry["n"][who].astype(np.int64)
        near = 3 * np.maximum(n[left], n[right]) <= 4 * np.minimum(n[left], n[right])
        left, right = left[near], right[near]
        band = entry["band"][who[left]]
        order = np.lexsort((band, fp[right], fp[left]))
        left, right, band = left[order], right[order], band[order]
        fresh = np.append(True, (fp[left][1:] != fp[left][:-1]) | (fp[right][1:] != fp[right][:-1]) | (band[1:] != band[:-1]))[: len(left)]
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(left)))
        slack = entry["slack"][who].astype(np.int64)
        out.append(_emit(1, len(at), a=fp[left[at]], b=fp[right[at]], band=band[at], x=times, y=(slack[left[at]] << 32) | (slack[right[at]] & 0xFFFFFFFF), na=n[left[at]], nb=n[right[at]]))
        hot = np.repeat(size > HOT, size)
        if hot.any():
            node, times = np.unique(who[hot], return_counts=True)
            # entries of one set and band from several tasks
            order = np.lexsort((entry["band"][node], entry["fp"][node]))
            node, times = node[order], times[order]
            first = np.flatnonzero(np.append(True, (entry["fp"][node][1:] != entry["fp"][node][:-1]) | (entry["band"][node][1:] != entry["band"][node][:-1])))
            one = entry[node[first]]
            out.append(_emit(2, len(one), a=one["fp"].copy(), band=one["band"].copy(), x=one["slack"].astype(np.int64), y=np.add.reduceat(times, first), na=one["n"].copy()))
            run = mix(sig ^ mix(np.full(1, table.column("bucket")[0].as_py(), np.uint64) + U64(1))[0])
            some = hot & (run % U64(STAR_RUNS) == 0)
            out.append(_emit(3, int(some.sum()), a=fp[some], b=run[some], na=n[some]))
    trim()
    return pa.concat_tables(out)


def shares(df: DataFrame, text: str) -> np.ndarray:
    """Number of buckets of each band, by the signatures that texts of so many words make. Balance
    depends on it, results do not."""
    words = F.char_length(text) - F.char_length(F.translate(text, " \n\t\r", "")) + 1
    by = df.where(F.col(text).isNotNull()).groupBy(F.floor(F.log2(words) * 8).alias("k")).agg(F.sum(words.cast("long")).alias("words"), F.sum(F.octet_length(text).cast("long")).alias("bytes")).collect()
    weight = np.zeros(len(HI))
    for r in by:
        n = 2 ** ((r.k + 0.5) / 8)
        band = int(np.searchsorted(HI, n))
        for b in [band, *([band - 1] if band and 3 * n <= 4 * HI[band - 1] else [])]:
            weight[b] += r.words * (1.5 if HI[b] <= SMALL else 0.5)
    buckets = max(partitions_for(df.sparkSession), sum(r.bytes for r in by) // BUCKET_BYTES)
    return np.maximum(1, np.rint(weight / max(weight.sum(), 1.0) * buckets)).astype(np.int64)


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """What all buckets show, see meet()."""
    share = shares(df, text)

    def send(batches):
        sender = Sender(share)
        for b in batches:
            ids = b.column(0)
            values, nulls = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            for i, j, sets in shingle_sets(b.column(1)):
                sender.add(values[i:j], nulls[i:j], sets)
                if sender.held > FLUSH:
                    yield from sender.batches()
        yield from sender.batches()

    own = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(send, "bucket int, docs binary, entries binary, sigs binary").groupBy("bucket").applyInArrow(meet, _FOUND)


# ---------------------------------------------------------------- verification


def _bitmap(ids: DataFrame) -> np.ndarray:
    """2**24 bits that are set at hashes of ids: two megabytes, however many ids."""
    h = F.xxhash64("id")
    words = ids.select(F.pmod(h, F.lit(1 << 18)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(id), 18), 64) as int))").alias("bit"))
    out = np.zeros(1 << 18, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        out[r.w] = r.bits
    return out


def shingles_of(df: DataFrame, fps: DataFrame, owners: DataFrame, key: str, text: str) -> DataFrame:
    """id, fp and set (uint64 hashes) of the wanted sets, from their owners' texts: texts are not
    moved, a bitmap of the owners' ids tells each task which of its rows to read."""
    spark = df.sparkSession
    wanted = materialize(spark, owners.join(fps.select("fp").distinct(), "fp", "left_semi"), "jaccard-wanted")
    shared = spark.sparkContext.broadcast(_bitmap(wanted))

    def emit(batches):
        bits = shared.value
        for b in batches:
            h = b.column(2).to_numpy()
            hit = np.flatnonzero((bits[h % (1 << 18)] >> ((h >> 18) % 64)) & 1)
            if not len(hit):
                continue
            ids = b.column(0).take(pa.array(hit))
            for i, j, sets in shingle_sets(b.column(1).take(pa.array(hit))):
                fp = fingerprints(sets, np.array([len(s) for s in sets], dtype=np.int64))
                for k in range(0, j - i, 256):
                    m = min(256, j - i - k)
                    yield pa.RecordBatch.from_arrays([ids.slice(i + k, m), pa.array(fp[k : k + m].view(np.int64)), pa.array([s.tobytes() for s in sets[k : k + m]], pa.binary())], names=["id", "fp", "set"])

    named = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    sets = named.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(emit, "id long, fp long, set binary")
    return materialize(spark, sets.join(wanted, ["id", "fp"], "left_semi"), "jaccard-sets")


def verify(df: DataFrame, pairs: DataFrame, owners: DataFrame, key: str, text: str) -> DataFrame:
    """a, b, inter, na, nb of the pairs; owners: fp, id (the document whose set it is)."""
    sets = shingles_of(df, pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))), owners, key, text)

    def intersect(batches):
        for b in batches:
            inter, na, nb = [], [], []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                inter.append(int((x[at] == y).sum())), na.append(len(x)), nb.append(len(y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(v, pa.int64()) for v in (inter, na, nb)]], names=["a", "b", "inter", "na", "nb"])

    first = pairs.select("a", "b").join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a")
    both = first.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(intersect, "a long, b long, inter long, na long, nb long")


def linked(v: DataFrame) -> DataFrame:
    return v.where(DEN * F.col("inter") >= NUM * (F.col("na") + F.col("nb") - F.col("inter")))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, labels). documents: id, n, rep (smallest id with the same set; the id itself
    without shingles). labels: node (a rep), label (smallest id of its component)."""
    spark = df.sparkSession
    found = materialize(spark, find(df, key, text), "jaccard-found")
    docs = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("fp"), F.col("x").alias("n"))
    owners = materialize(spark, docs.where("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("id")), "jaccard-owners")
    hot_count = found.where("kind = 2").groupBy("a", "band").agg(F.sum("y").alias("hot"), F.first("x").alias("slack"), F.first("na").alias("n"))
    hot_count = materialize(spark, hot_count, "jaccard-hot")
    pairs = found.where("kind = 1").groupBy("a", "b", "band").agg(F.sum("x").alias("shared"), F.max("y").alias("slacks"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    for side, shift in (("a", 32), ("b", 0)):
        counted = hot_count.select(F.col("a").alias(side), "band", F.col("hot").alias(f"hot_{side}"))
        slack = F.shiftright("slacks" if shift else F.shiftleft("slacks", 32), 32)
        pairs = pairs.join(counted, [side, "band"], "left").withColumn(f"need_{side}", slack + 1 - F.coalesce(f"hot_{side}", F.lit(0)))
    large = F.element_at(F.array(*[F.lit(bool(h > SMALL)) for h in HI]), F.col("band") + 1)
    kept = pairs.where(~large | (F.col("shared") >= F.greatest("need_a", "need_b"))).select("a", "b").distinct()
    kept = materialize(spark, kept, "jaccard-pairs")
    edges = linked(verify(df, kept, owners, key, text)).select("a", "b")
    edges = materialize(spark, edges, "jaccard-edges")
    needy = hot_count.where("hot > slack").groupBy("a").agg(F.max("hot").alias("hot"), F.first("n").alias("n"))
    needy = materialize(spark, needy, "jaccard-needy")
    member = materialize(spark, found.where("kind = 3").select("a", "b").join(needy, "a"), "jaccard-runs")
    # the member with most frequent signatures has lost least of what its run shares
    center = member.groupBy("b").agg(F.max_by(F.struct(F.col("a").alias("center"), F.col("n").alias("center_n")), F.struct("hot", "a")).alias("c")).select("b", "c.*")
    near = member.join(materialize(spark, center, "jaccard-centers"), "b").where((F.col("a") != F.col("center")) & _apart("n", "center_n"))
    edges = edges.union(_verified(df, near.select("a", F.col("center").alias("b")), owners, key, text))
    edges = edges.union(_verified(df, _prefix_pairs(df, needy, owners, _labels(edges, owners), key, text), owners, key, text))
    labels = _labels(edges, owners)
    rep = docs.join(owners.withColumnRenamed("id", "rep"), "fp", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    return rep, labels


def _apart(n: str, m: str):
    """Sizes that allow similarity."""
    return (3 * F.col(n) <= 4 * F.col(m)) & (3 * F.col(m) <= 4 * F.col(n))


def _verified(df: DataFrame, pairs: DataFrame, owners: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b in either order) that link."""
    spark = df.sparkSession
    pairs = materialize(spark, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    return materialize(spark, linked(verify(df, pairs, owners, key, text)).select("a", "b"), "jaccard-edges")


def _prefix_pairs(df: DataFrame, members: DataFrame, owners: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """a, b: all pairs of members (a, n) in different components that can link. A pair that
    links has 3/7 of both sizes in common. In one order of all shingles, rare before frequent,
    their first common one is followed by all the others: so many must be left in both."""
    spark = df.sparkSession
    comp = members.join(owners.withColumnRenamed("fp", "a"), "a").join(labels.withColumnRenamed("node", "id"), "id", "left").select(F.col("a").alias("fp"), "n", F.coalesce("label", "id").alias("comp"))
    comp = materialize(spark, comp, "jaccard-members")
    sets = shingles_of(df, comp, owners, key, text)

    def explode(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [np.frombuffer(x, "<i8") for x in part.column(3).to_pylist()]
                m = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(m) for k in range(3)], pa.array(np.concatenate(found))], names=["fp", "n", "comp", "token"])

    tokens = sets.join(comp, "fp").select("fp", "n", "comp", "set").mapInArrow(explode, "fp long, n long, comp long, token long")
    # only shingles that several components have can be in common; each set's as one array, rare first
    least = F.ceil(F.col("n") * 3 / 4)
    met = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    across = tokens.join(met.select("token", "df"), "token")
    ordered = across.groupBy("fp", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    ordered = ordered.withColumn("left", F.size("t")).where(F.col("left") >= least)
    prefix = ordered.select("fp", "comp", "n", "left", F.posexplode(F.slice("t", 1, (F.col("left") - least + 1).cast("int"))).alias("i", "x"))
    prefix = materialize(spark, prefix.select("fp", "comp", "n", (F.col("left") - F.col("i")).alias("rest"), "x.token"), "jaccard-prefix")
    x, y = (prefix.select(*[F.col(c).alias(f"{c}{k}") for c in ("fp", "comp", "n", "rest")], "token") for k in (1, 2))
    common = F.ceil((F.col("n1") + F.col("n2")) * 3 / 7)
    enough = F.least("rest1", "rest2") >= common
    return x.join(y, "token").where((F.col("comp1") < F.col("comp2")) & _apart("n1", "n2") & enough).select(F.col("fp1").alias("a"), F.col("fp2").alias("b"))


def _labels(edges: DataFrame, owners: DataFrame) -> DataFrame:
    a, b = (owners.select(F.col("fp").alias(k), F.col("id").alias(f"id_{k}")) for k in "ab")
    named = edges.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return components(named)


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    docs, labels = similar(df, key, text)
    return docs.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the documents whose component has a smaller id."""
    lost = report(df, key, text).where("component_id < doc_id").select("doc_id").distinct()
    lost = materialize(df.sparkSession, lost, "jaccard-lost")
    return df.join(lost.select(F.col("doc_id").alias(key)).hint("shuffle_hash"), key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
