"""Suffix-array dedup: bytes under long strings that an earlier document has as well.

The suffixes are partitioned by content. Of each LENGTH-byte string one GRAM-byte part is its
anchor: the part with the smallest hash. Equal strings have equal anchors at equal places, so
each string is looked at in its anchor's partition only. An anchor comes with its context,
the bytes any string around it can reach, and first only hashes travel: of the anchor, of its
context, and where it is. An occurrence whose whole context an earlier document has is
covered. An anchor without a second document is done with. What remains are anchors with
several different contexts: the ends of common passages.

Their contexts are fetched and go, in document order, through a logarithmic index family: a
batch gets the suffix array of its contexts (all suffixes of at least LENGTH bytes, sorted by
that prefix), is scanned against itself and merge-scanned against the sorted levels that
exist, and becomes a level; levels of like size merge, so n batches leave log2(n) levels and
each suffix is merged as often.

A string counts as earlier if it starts in a document with a smaller doc_id; strings are
judged on the input. Rows are told apart by doc_id and a 64-bit hash of the text, parts and
contexts by 64-bit hashes each, and a string is covered on their word only if both agree.
Defined results: null texts are empty; texts below LENGTH bytes keep all; texts of any length are read whole; documents with one doc_id are not
earlier than each other, a repeated row gets its result again; a null doc_id comes last; an
empty table gives an empty one; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _BYTE, LANES, U64, chunks, materialize, mix, partitions_for, powers, release, text_buffer, text_bytes, trim
from .jaccard import runs

LENGTH, GRAM = 50, 20
#: Anchors held before they are sent, contexts of a batch, anchors of a slice.
FLUSH, BATCH, SLICE = 2_000_000, 4096, 500_000
#: Bytes of text for one bucket of anchors, and for one of open contexts or one home of documents.
BUCKET_BYTES, CONTEXT_BYTES = 40 << 20, 13 << 20
_LAST = (1 << 63) - 1
_NEVER = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], by doubling."""
    step, out = 1, x
    while step * 2 <= width:
        out = best(out[: len(out) - step], out[step:])
        step *= 2
    rest = width - step
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For each anchor: its place, its row, bytes of context before and from it, and the hashes
    of the part and of the context."""
    n, width = len(data), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    p, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:n], out=sums[1:])
    parts = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = _sliding(parts, width, np.minimum)  # by start of the string
    inside = np.zeros(n + 1, np.int32)  # strings that stay in their row
    own = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[own], 1)
    np.add.at(inside, offsets[own + 1] - length + 1, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, U64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    highest = _sliding(padded, width, np.maximum)  # over the strings around each part
    at = np.flatnonzero((highest[: len(parts)] == parts) & (parts > 0))
    row = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(at - offsets[row], length - gram)
    right = np.minimum(offsets[row + 1] - at, length)
    context = mix((sums[at + right] - sums[at - left]) * inverse[at - left] + left.astype(np.uint64) * LANES[30] + right.astype(np.uint64) * LANES[31])
    return at, row, left, right, parts[at], context


_ENTRY = np.dtype([("doc", "<i8"), ("th", "<i8"), ("count", "<u4")])
_ANCHOR = np.dtype([("part", "<u8"), ("ctx", "<u8"), ("at", "<u4"), ("left", "u1"), ("right", "u1")])


def _sent(held: list, buckets: int):
    doc, th, at, left, right, part, ctx = (np.concatenate(x) for x in zip(*held))
    bucket = part % U64(buckets)
    bucket = bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    out = np.zeros(len(order), _ANCHOR)
    out["part"], out["ctx"] = part[order], ctx[order]
    out["at"], out["left"], out["right"] = at[order], left[order], right[order]
    doc, th = doc[order], th[order]
    rows: list[list] = [[], [], []]
    for k, a, b in runs(bucket[order]):
        heads = np.flatnonzero(np.append(True, (doc[a + 1 : b] != doc[a : b - 1]) | (th[a + 1 : b] != th[a : b - 1])))
        entry = np.zeros(len(heads), _ENTRY)
        entry["doc"], entry["th"], entry["count"] = doc[a:b][heads], th[a:b][heads], np.diff(np.append(heads, b - a))
        for r, x in zip(rows, (k, entry.tobytes(), out[a:b].tobytes())):
            r.append(x)
    for i in range(0, len(rows[0]), 64):
        yield pa.RecordBatch.from_arrays([pa.array(rows[0][i : i + 64], pa.int32()), pa.array(rows[1][i : i + 64], pa.binary()), pa.array(rows[2][i : i + 64], pa.binary())], names=["bucket", "docs", "anchors"])


_HEAD = np.dtype([("doc", "<i8"), ("th", "<i8"), ("covered", "<u4"), ("open", "<u4")])
_MET = "doc long, th long, covered binary, open binary"
_PACKED = "home int, heads binary, covered binary, open binary"


def _met(part: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some anchors those whose whole context an earlier document has, and the open ones, whose
    contexts have to be compared: their numbers."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    twice = np.zeros(len(part), bool)  # parts of one document only are done with
    twice[1:] = part[1:] == part[:-1]
    twice[:-1] |= twice[1:]
    order, part = order[twice], part[twice]
    if not len(order):
        return order, order
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    several = np.minimum.reduceat(doc[order], heads) < np.maximum.reduceat(doc[order], heads)
    keep = np.repeat(several, np.diff(np.append(heads, len(part))))
    order, part = order[keep], part[keep]
    again = np.lexsort((doc[order], ctx[order], part))
    order, part = order[again], part[again]
    own, now = ctx[order], doc[order]
    if not len(order):
        return order, order
    fresh = np.append(True, (part[1:] != part[:-1]) | (own[1:] != own[:-1]))
    first = np.flatnonzero(fresh)
    covered = now > np.repeat(now[first], np.diff(np.append(first, len(part))))
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    contexts = np.add.reduceat(fresh.astype(np.int64), heads)
    open_ = ~covered & np.repeat(contexts > 1, np.diff(np.append(heads, len(part))))
    return order[covered], order[open_]


def meet(table: pa.Table, homes: int) -> pa.Table:
    """What one bucket shows of its documents: covered ranges (pairs of uint32) and open anchors
    (part hash, place, left, right), laid out by the documents' homes, a row for each home. A
    bucket is worked off in slices of parts, so that temporary arrays do not follow its size."""
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), _ENTRY)
    found = np.frombuffer(b"".join(table.column("anchors").to_pylist()), _ANCHOR)
    who = np.repeat(np.arange(len(docs), dtype=np.int32), docs["count"])
    slices = max(1, -(-len(found) // SLICE))
    of = (mix(found["part"].astype(np.uint64)) % U64(slices)).astype(np.int32) if slices > 1 else np.zeros(len(found), np.int32)
    covered, opened = [], []
    for k in range(slices):
        own = np.flatnonzero(of == k)
        hit, left = _met(found["part"][own].astype(np.uint64), found["ctx"][own].astype(np.uint64), docs["doc"][who[own]])
        covered.append(own[hit]), opened.append(own[left])
    trim()
    rows: dict[int, list] = {}
    for kind, own in ((0, np.concatenate(covered)), (1, np.concatenate(opened))):
        own = own[np.argsort(who[own], kind="stable")]
        if kind == 0:
            raw = np.stack([found["at"][own] - found["left"][own], found["at"][own] + found["right"][own]], 1).astype("<u4")
        else:
            raw = np.zeros(len(own), _OPEN)
            for c in ("part", "at", "left", "right"):
                raw[c] = found[c][own]
        for w, a, b in runs(who[own]):
            rows.setdefault(w, [b"", b""])[kind] = raw[a:b].tobytes()
    at = np.fromiter(rows, np.int64, len(rows))
    blobs = list(rows.values())
    head = np.zeros(len(at), _HEAD)
    head["doc"], head["th"] = docs["doc"][at], docs["th"][at]
    head["covered"], head["open"] = [len(x[0]) for x in blobs], [len(x[1]) for x in blobs]
    home = (mix(head["doc"].astype(np.uint64) ^ mix(head["th"].astype(np.uint64))) % U64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    out = [(k, head[order[a:b]].tobytes(), *(b"".join(blobs[i][j] for i in order[a:b].tolist()) for j in (0, 1))) for k, a, b in runs(home[order])]
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]], names=["home", "heads", "covered", "open"])


def gather(table: pa.Table) -> pa.Table:
    """The documents of one home: all covered ranges and open anchors of each in one row, null
    where it has none."""
    heads = np.frombuffer(b"".join(table.column("heads").to_pylist()), _HEAD)
    raw = [b"".join(table.column(c).to_pylist()) for c in ("covered", "open")]
    edges = [np.concatenate([[0], np.cumsum(heads[c], dtype=np.int64)]).tolist() for c in ("covered", "open")]
    order = np.lexsort((heads["th"], heads["doc"]))
    doc, th = heads["doc"][order], heads["th"][order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))[: len(doc)])
    blobs = [[b"".join(raw[j][edges[j][i] : edges[j][i + 1]] for i in order[a:b].tolist()) or None for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)])] for j in (0, 1)]
    trim()
    return pa.Table.from_arrays([pa.array(doc[first]), pa.array(th[first]), *[pa.array(x, pa.binary()) for x in blobs]], names=["doc", "th", "covered", "open"])


_OPEN = np.dtype([("part", "<u8"), ("at", "<u4"), ("left", "u1"), ("right", "u1")])


# ------------------------------------------------------------- the index family


class IndexFamily:
    """Levels of sorted suffixes, each with the earliest document that has it."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def suffix_array(self, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted suffix prefixes, order, context and place of each suffix before sorting)."""
        size = np.array([len(c) for c in contexts], dtype=np.int64)
        n = np.maximum(size - self.length + 1, 0)
        who = np.repeat(np.arange(len(contexts)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        data = np.frombuffer(b"".join(contexts), np.uint8)
        at = (np.cumsum(size) - size)[who] + place
        table = np.ones((len(at), self.length + 1), np.uint8)  # the last byte keeps trailing zeros
        for k in range(self.length):
            table[:, k] = data[at + k]
        keys = table.view(f"S{self.length + 1}").ravel()
        order = np.argsort(keys, kind="stable")
        return keys[order], order, who, place

    def add(self, contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds a batch, whose documents are not before those added so far. Returns the context
        and place of each suffix that a smaller document has."""
        keys, order, who, place = self.suffix_array(contexts)
        if not len(keys):
            return who, place
        doc = docs[who][order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        least = np.minimum.reduceat(doc, first)
        own, earliest = keys[first], least.copy()
        for level, level_docs in self.levels:
            at = np.minimum(np.searchsorted(level, own), len(level) - 1)
            earliest = np.where(level[at] == own, np.minimum(earliest, level_docs[at]), earliest)
        hit = doc > np.repeat(earliest, np.diff(np.append(first, len(keys))))
        self.levels.append((own, earliest))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self._merge()
        return who[order[hit]], place[order[hit]]

    def _merge(self) -> None:
        (a, da), (b, db) = self.levels[-2:]
        keys, docs = np.concatenate([a, b]), np.concatenate([da, db])
        order = np.lexsort((docs, keys)) if len(keys) < 2 else np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.levels[-2:] = [(keys[first], np.minimum.reduceat(docs, first))]


def compare(table: pa.Table) -> pa.Table:
    """Covered ranges from one bucket's open contexts."""
    table = table.sort_by("doc")
    docs = table.column("doc").to_numpy()
    ths, starts, texts = table.column("th").to_numpy(), table.column("start").to_numpy(), table.column("context").to_pylist()
    family = IndexFamily()
    out_doc, out_th, out = [], [], []
    for i in range(0, len(docs), BATCH):
        who, place = family.add(texts[i : i + BATCH], docs[i : i + BATCH])
        order = np.lexsort((place, who))
        who, place = who[order], place[order]
        cut = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(who)]):
            k = i + int(who[a])
            start = starts[k] + place[a:b]
            out_doc.append(int(docs[k])), out_th.append(int(ths[k])), out.append(np.stack([start, start + LENGTH], 1).astype("<u4").tobytes())
    return pa.Table.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_th, pa.int64()), pa.array(out, pa.binary())], names=["doc", "th", "covered"])


# ----------------------------------------------------------------- the operator


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def ranges(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th, covered: byte ranges to remove as pairs of uint32, in no order, overlapping."""
    spark = df.sparkSession
    size = text_bytes(df, text)
    buckets, fine = (max(partitions_for(spark), size // n) for n in (BUCKET_BYTES, CONTEXT_BYTES))
    rows = _identified(df, key, text).select("doc", "th", "text")

    def send(batches):
        held, many = [], 0
        for b in batches:
            docs, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = text_buffer(b.column(2))
            for i, j in chunks(offsets):
                low = int(offsets[i])
                own = offsets[i : j + 1] - low
                at, row, left, right, part, ctx = anchors(data[low : int(offsets[j])], own)
                held.append((docs[i + row], ths[i + row], (at - own[row]).astype(np.uint32), left.astype(np.uint8), right.astype(np.uint8), part, ctx))
                many += len(at)
                if many > FLUSH:
                    yield from _sent(held, buckets)
                    held, many = [], 0
        if many:
            yield from _sent(held, buckets)

    met = rows.mapInArrow(send, "bucket int, docs binary, anchors binary").groupBy("bucket").applyInArrow(lambda table: meet(table, fine), _PACKED).groupBy("home").applyInArrow(gather, _MET)
    met = materialize(spark, met, "suffix-met")
    opened = met.where("open is not null").select("doc", "th", "open")

    def fetch(batches):
        for b in batches:
            docs, ths, texts, opens = (b.column(k) for k in range(4))
            for r in range(b.num_rows):
                raw = texts[r].as_py().encode()
                found = np.frombuffer(opens[r].as_py(), _OPEN)
                n = len(found)
                starts = found["at"].astype(np.int64) - found["left"]
                stops = found["at"].astype(np.int64) + found["right"]
                cut = [raw[s:e] for s, e in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((found["part"] % U64(fine)).astype(np.int32)), pa.array(np.full(n, docs[r].as_py())), pa.array(np.full(n, ths[r].as_py())), pa.array(starts), pa.array(cut, pa.binary())],
                    names=["bucket", "doc", "th", "start", "context"],
                )

    contexts = rows.join(opened.hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "text", "open")
    contexts = contexts.mapInArrow(fetch, "bucket int, doc long, th long, start long, context binary")
    compared = contexts.groupBy("bucket").applyInArrow(compare, "doc long, th long, covered binary")
    compared = materialize(spark, compared, "suffix-compared")
    del contexts, opened
    release(spark)
    return met.where("covered is not null").select("doc", "th", "covered").union(compared)


def union(blobs: list[bytes]) -> list[tuple[int, int]]:
    """Disjoint sorted ranges; ranges that touch are one."""
    pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return list(zip(pairs[first, 0].tolist(), reach[np.append(first[1:] - 1, len(pairs) - 1)].tolist()))


def _with_ranges(df: DataFrame, key: str, text: str) -> DataFrame:
    """_identified() and covered: all blobs of the document."""
    found = ranges(df, key, text).groupBy("doc", "th").agg(F.collect_list("covered").alias("covered"))
    return _identified(df, key, text).join(found.hint("shuffle_hash"), ["doc", "th"], "left")


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the covered bytes cut out of the text; characters of which a byte goes that are
    no longer valid are left out as well. Null texts stay null."""
    from pyspark.sql import types as T

    joined = _with_ranges(df, key, text)
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema.fields]])

    def cut(batches):
        for b in batches:
            rows = b.column(0)
            done = [None if t is None else kept_bytes(t.encode(), union(c)).decode("utf-8", "ignore") if c else t for t, c in zip(rows.field(text).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if f.name == text else rows.field(f.name) for f in rows.type], names=[f.name for f in rows.type])

    return joined.select("row", "covered").mapInArrow(cut, out)


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256."""
    joined = _with_ranges(df.select(key, text), key, text)

    def digest(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, spans = t.encode(), union(c) if c else []
                values = len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()
                for col, v in zip(cols, values):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = joined.select(F.col(f"row.`{key}`").cast("long").alias("doc_id"), "text", "covered")
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
