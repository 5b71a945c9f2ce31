"""Benchmark decontamination by winnowing.

Of every run of WINDOW - GRAM + 1 consecutive word 5-grams the smallest hash is kept, on both
sides. Two texts that share WINDOW words in a row therefore share a kept hash at the same
place of the shared span: every such span is found, and a found pair of places is extended
word by word to the maximal common run. Benchmark items shorter than a window are looked up
whole, by one hash for each length that occurs.

A benchmark of at most BLOCK_BYTES of text is broadcast, and the documents pass Python once. A
larger one is not: fingerprints of both sides are joined (see joined()).

Defined results: null and empty texts have no words and are never hit; items without words
match nothing; a null item id is listed as "null"; repeated items with one id count once;
repeated documents are each reported; texts of any length are looked at whole; an empty
benchmark hits nothing. annotate() replaces columns of the input named like its own (leak_*),
remove() keeps them; all others pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ALNUM, U64, chunks, gram_hashes, materialize, span_hashes, text_buffer, word_spans

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
#: log2 of the bits of the bitmap that drops fingerprints without a match: 16 MB.
BITMAP = 27
_NEVER = U64(0xFFFFFFFFFFFFFFFF)
COLUMNS = T.StructType(
    [
        T.StructField("leak_words", T.LongType()),
        T.StructField("leak_hits", T.LongType()),
        T.StructField("leak_starts", T.ArrayType(T.LongType())),
        T.StructField("leak_ends", T.ArrayType(T.LongType())),
        T.StructField("leak_items", T.ArrayType(T.StringType())),
    ]
)


def words_of(column: pa.Array):
    """Word hashes of a column, and for each row the number of its first word, chunk by chunk."""
    data, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        low = int(offsets[i])
        part, own = data[low : int(offsets[j])], offsets[i : j + 1] - low
        starts, ends, first = word_spans(part, own, ALNUM)
        yield i, j, span_hashes(part, starts, ends), first


def kept(grams: np.ndarray, run: int) -> np.ndarray:
    """Places of the smallest value of each run of consecutive values (all of them on ties)."""
    if len(grams) < run:
        return np.zeros(0, np.int64)
    low = grams[: len(grams) - run + 1].copy()
    for j in range(1, run):
        np.minimum(low, grams[j : j + len(low)], out=low)
    chosen = np.zeros(len(grams), dtype=bool)
    for j in range(run):
        chosen[j : j + len(low)] |= grams[j : j + len(low)] == low
    return np.flatnonzero(chosen & (grams != _NEVER))


def thinned(places: list[int], item: np.ndarray, gram: int) -> list[int]:
    """Places of one hash without the inner ones of a repetition: where an item repeats itself every
    gram words or less, what a text shares with it starts at the repetition's start, ends at its end, or
    lies in it and is found from either."""
    out = []
    for i, r in enumerate(places):
        if 0 < i < len(places) - 1:
            before, after = places[i - 1], places[i + 1]
            if r - before == after - r <= gram and item[before] == item[after]:
                continue
        out.append(r)
    return out


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values are equal."""
    n, at, step = min(len(x), len(y)), 0, 16
    while at < n:
        differ = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return n


class Block:
    """Fingerprints of some benchmark items."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = ["null" if x is None else str(x) for x in ids]
        words, first = [], [0]
        for _, _, hashes, at in words_of(pa.array(texts, pa.string())):
            words.append(hashes)
            first += (at[1:] + first[-1]).tolist()
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.first = np.array(first, dtype=np.int64)
        self.item = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        lookup: dict[int, dict[int, list[int]]] = {}
        for k in range(len(self.ids)):
            a, b = int(self.first[k]), int(self.first[k + 1])
            n = b - a
            if n >= window:
                grams = gram_hashes(self.words[a:b], gram)
                for p in kept(grams, window - gram + 1):
                    lookup.setdefault(gram, {}).setdefault(int(grams[p]), []).append(a + int(p))
            elif n:
                lookup.setdefault(-n, {}).setdefault(int(gram_hashes(self.words[a:b], n)[0]), []).append(a)
        self.tables = []
        for k, found in sorted(lookup.items()):
            keys = np.array(sorted(found), dtype=np.uint64)
            near = np.zeros(1 << 18, dtype=bool)
            near[keys & U64((1 << 18) - 1)] = True
            at = [found[int(x)] for x in keys]
            self.tables.append((k, keys, near, [thinned(x, self.item, gram) for x in at] if k > 0 else at))

    def places(self, words: np.ndarray, first: np.ndarray):
        """Yields (place in words, place in the items, whole item's length or 0)."""
        for k, keys, near, at in self.tables:
            size = abs(k)
            grams = gram_hashes(words, size)
            if not len(grams):
                continue
            # a gram that runs into the next row
            for d in range(1, size):
                cut = first[1:-1] - d
                grams[cut[(cut >= 0) & (cut < len(grams))]] = _NEVER
            where = kept(grams, self.window - self.gram + 1) if k > 0 else np.arange(len(grams))
            where = where[near[grams[where] & U64((1 << 18) - 1)]]
            if len(where):
                at_key = np.searchsorted(keys, grams[where])
                at_key[at_key == len(keys)] = 0
                hit = keys[at_key] == grams[where]
                for p, q in zip(where[hit].tolist(), at_key[hit].tolist()):
                    for r in at[q]:
                        yield p, r, size if k < 0 else 0

    def hits(self, words: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By row: hit ranges of words (counted in the row) and ids of the items."""
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        done: dict[tuple[int, int], int] = {}  # (row, diagonal): end of the run last extended
        for p, r, whole in self.places(words, first):
            row = int(np.searchsorted(first, p, "right")) - 1
            low, high = int(first[row]), int(first[row + 1])
            k = int(self.item[r])
            if whole:
                if p + whole > high or not np.array_equal(words[p : p + whole], self.words[r : r + whole]):
                    continue
                a, b = p, p + whole
            else:
                if done.get((row, p - r), -1) > p:
                    continue
                start, stop = int(self.first[k]), int(self.first[k + 1])
                a = p - agreeing(words[low:p][::-1], self.words[start:r][::-1])
                b = p + agreeing(words[p:high], self.words[r:stop])
                done[row, p - r] = max(b, p + 1)
                if b - a < self.window:
                    continue
            spans, ids = found.setdefault(row, ([], set()))
            spans.append((a - low, b - low))
            ids.add(self.ids[k])
        return found


def annotate(df: DataFrame, bench: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with leak_words (words of the text), leak_hits (words inside an occurring window),
    leak_starts/leak_ends (hit word ranges, sorted and disjoint) and leak_items (sorted)."""
    base = [f for f in df.schema.fields if f.name not in COLUMNS.names]
    df = df.select(*[F.col(f"`{f.name}`") for f in base])
    items = bench.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length(F.coalesce("t", F.lit(""))) + F.lit(64))).first()[0] or 0
    if size > block_bytes:
        return joined(df, items, text, window, gram)
    rows = items.collect()
    shared = df.sparkSession.sparkContext.broadcast(Block([r.k for r in rows], [r.t for r in rows], window, gram))

    def apply(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *found_in(shared.value, b.column(text))], names=[*b.schema.names, *COLUMNS.names])

    return df.mapInArrow(apply, T.StructType([*base, *COLUMNS.fields]))


def found_in(block: Block, column: pa.Array) -> list[pa.Array]:
    """COLUMNS of texts."""
    n = len(column)
    count, spans, items = [0] * n, [()] * n, [()] * n
    for i, j, words, first in words_of(column):
        count[i:j] = np.diff(first).tolist()
        for row, (found, ids) in block.hits(words, first).items():
            spans[i + row], items[i + row] = found, ids
    merged = [_disjoint(x) for x in spans]
    return [
        pa.array(count, pa.int64()),
        pa.array([sum(e - s for s, e in x) for x in merged], pa.int64()),
        pa.array([[s for s, _ in x] for x in merged], pa.list_(pa.int64())),
        pa.array([[e for _, e in x] for x in merged], pa.list_(pa.int64())),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
    ]


def fingerprints(df: DataFrame, text: str, window: int, gram: int, short: list[int], near=None) -> DataFrame:
    """th (SHA-256 of the text), words (their number) and prints: the distinct kept hashes of grams,
    and of all grams of each size in short. near: a broadcast bitmap of hashes that matter."""

    def apply(batches):
        bitmap = near.value if near is not None else None
        for b in batches:
            counts, prints = [], []
            for _, _, words, first in words_of(b.column(1)):
                for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = gram_hashes(words[a:z], gram)
                    every = [own[kept(own, window - gram + 1)], *[gram_hashes(words[a:z], k) for k in short if k <= z - a]]
                    found = np.unique(np.concatenate(every))
                    if bitmap is not None:
                        at = found & U64(8 * len(bitmap) - 1)
                        found = found[(bitmap[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0]
                    counts.append(z - a), prints.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], names=["th", "words", "prints"])

    texts = df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("th"), F.col(text).alias("t"))
    return texts.mapInArrow(apply, "th string, words long, prints array<long>")


def bitmap_of(hashes: DataFrame, bits: int = BITMAP) -> np.ndarray:
    """A bitmap of 2 ** bits bits in which the hashes (column h) are set; its size does not follow theirs."""
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint8)


def joined(df: DataFrame, items: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """annotate() for a benchmark of any size. Fingerprints of both sides are joined, those of the
    documents after a bitmap of fixed size has dropped most that no item has; each text with a
    common fingerprint meets the items it shares one with, and hits are extended there. Equal
    texts are looked at once. Texts with a hit go through Python a second time, all others once."""
    spark = df.sparkSession
    items = materialize(spark, items, "leak-items")
    lengths = T.StructType([T.StructField("n", T.LongType())])

    def counted(batches):
        for b in batches:
            for _, _, _, first in words_of(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(first))], names=["n"])

    short = [int(r.n) for r in items.select("t").mapInArrow(counted, lengths).where(F.col("n").between(1, window - 1)).distinct().collect()]
    held = fingerprints(items, "t", window, gram, short)
    held = held.where("words > 0").join(items.withColumn("th", F.sha2(F.coalesce("t", F.lit("")), 256)), "th").select(F.explode("prints").alias("h"), F.coalesce("k", F.lit("null")).alias("k"), "th").distinct()
    held = materialize(spark, held, "leak-items-prints")
    near = spark.sparkContext.broadcast(bitmap_of(held.select("h").distinct()))
    prints = materialize(spark, fingerprints(df, text, window, gram, short, near).groupBy("th").agg(F.first("words").alias("words"), F.first("prints").alias("prints")), "leak-prints")
    pairs = prints.select("th", F.explode("prints").alias("h")).join(held.select("h", F.col("th").alias("item")), "h").select("th", "item").distinct()
    bodies = items.select(F.sha2(F.coalesce("t", F.lit("")), 256).alias("item"), F.coalesce("k", F.lit("null")).alias("k"), "t").distinct()
    wanted = pairs.join(bodies, "item").groupBy("th").agg(F.collect_list(F.struct("k", "t")).alias("items"))
    texts = df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("th"), F.col(text).alias("t")).join(prints.where(F.size("prints") > 0).select("th"), "th", "left_semi").dropDuplicates(["th"])

    def extend(batches):
        for b in batches:
            for th, t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = own.as_py()
                found = found_in(Block([x["k"] for x in own], [x["t"] for x in own], window, gram), pa.array([t], pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([th], pa.string()), *found[1:]], names=["leak_th", *COLUMNS.names[1:]])

    hits = texts.join(wanted, "th").select("th", "t", "items").mapInArrow(extend, T.StructType([T.StructField("leak_th", T.StringType()), *COLUMNS.fields[1:]]))
    hits = materialize(spark, hits.where("leak_hits > 0"), "leak-hits")
    known = prints.select(F.col("th").alias("leak_th"), F.col("words").alias("leak_words")).join(hits, "leak_th", "left")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("leak_row"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("leak_th"))
    out = own.join(known, "leak_th")
    return out.select(
        *[F.col(f"leak_row.`{c}`") for c in df.columns], "leak_words", F.coalesce("leak_hits", F.lit(0).cast("long")).alias("leak_hits"),
        *[F.coalesce(c, F.array().cast(COLUMNS[c].dataType)).alias(c) for c in COLUMNS.names[2:]],
    )


def _disjoint(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def report(df: DataFrame, bench: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per document: word counts, items and their digest, and the verdict."""
    found = annotate(df, bench, **options)
    return found.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col("leak_words").alias("n_words"),
        F.col("leak_hits").alias("n_hit"),
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"),
        (F.col("leak_hits") > 0).alias("contaminated"),
    )


def remove(df: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with their own columns, also those named like COLUMNS."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    return annotate(packed, bench, **options).where("leak_hits = 0").select(*[F.col(f"row.`{c}`") for c in df.columns])
