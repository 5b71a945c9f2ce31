"""Line dedup by pairwise alignment.

Lines are hashed without their outer blanks. A line that several documents hold leads each
later one to the earliest that holds it, so a line shared by n documents makes n - 1 pairs and
not n * n; no line is left out for being frequent. So does each shortest run of adjacent shared
lines with MIN_CHARS characters, from each line on and back from each line, so that each line of
a common block meets a document that has such a block with it. Where a document has lines of one
holder in another order than the holder, two following lines lead to the earliest document with
that order. These are at most four pairs a line. Each pair's shared lines are aligned with
patience diff: lines found once in both, the rarest first evidence there is, are anchors if
they keep their order, and the gaps between anchors are aligned in the same way, a gap
without such lines by a longest common subsequence of what both have in it. Runs of
aligned lines, adjacent in both documents but for blank lines, are common blocks. A block of
at least MIN_CHARS characters is deleted from the later document.

Documents are ordered by doc_id, then by a hash of their text; a null doc_id comes last. Rows
that are equal in both are one document and get one result. Null texts stay null; empty texts
and blank lines share nothing; an empty table gives an empty one. Other columns pass unchanged,
whatever their names. Time is linear in a text's lines but for gaps that have no line unique in
both documents, where it is the product of the gap's lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LANES, SPACED, chunks, discard, gram_hashes, materialize, mix, span_hashes, text_buffer, whole_hash

MIN_CHARS = 40
#: Pairs that get a copy of the earlier document's lines.
SHARE = 100
_LAST = (1 << 63) - 1


def patience(a: list[int], b: list[int], na: list[int] | None = None, nb: list[int] | None = None) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order. na, nb: line numbers; of alignments that are
    equally long in a gap without anchors, the one with most adjacent lines is taken."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if a[i:j] == b[k:m]:
            out += zip(range(i, j), range(k, m))
            continue
        once_a: dict[int, int] = {}
        for x in range(i, j):
            once_a[a[x]] = -1 if a[x] in once_a else x
        once_b: dict[int, int] = {}
        for y in range(k, m):
            once_b[b[y]] = -1 if b[y] in once_b else y
        both = [(once_a[b[y]], y) for y in range(k, m) if once_b[b[y]] == y and once_a.get(b[y], -1) >= 0]
        kept = increasing(both)
        if not kept:
            # the lines on both sides of the gap are aligned; they tell what is adjacent to them
            low, high = int(i > 0 and k > 0), int(j < len(a) and m < len(b))
            xs = [x for x in range(i - low, j + high) if x < i or x >= j or a[x] in once_b]
            ys = [y for y in range(k - low, m + high) if y < k or y >= m or b[y] in once_a]
            if len(xs) > low + high and len(ys) > low + high:
                found = longest([a[x] for x in xs], [b[y] for y in ys], na and [na[x] for x in xs], nb and [nb[y] for y in ys])
                out += [(xs[x], ys[y]) for x, y in found if i <= xs[x] < j and k <= ys[y] < m]
            continue
        edges = [(i - 1, k - 1), *kept, (j, m)]
        out += kept
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]) if x + 1 < u and y + 1 < v]
    return sorted(out)


def longest(a: list[int], b: list[int], na: list[int] | None = None, nb: list[int] | None = None) -> list[tuple[int, int]]:
    """A longest common subsequence, and of these one with most steps that are adjacent by na
    and nb. Rows of the table are kept at every sqrt(len(a)) and made again on the way back."""
    n, m = len(a), len(b)
    values = {v: z for z, v in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([values[v] for v in a], np.int64), np.array([values[v] for v in b], np.int64)
    weight, none = min(n, m) + 1, -(1 << 60)
    near_a = np.append(False, np.diff(na) == 1) if na else np.zeros(n, bool)
    near_b = np.append(False, np.diff(nb) == 1) if nb else np.zeros(m, bool)

    def row(i, best, last):
        """best: of any alignment of a[:i + 1] and b[:k]; last: of those that end in their pair."""
        before = best[:-1]
        if near_a[i]:
            before = np.maximum(before, np.where(near_b, last[:-1] + 1, none))
        ends = np.full(m + 1, none)
        ends[1:] = np.where(y == x[i], before + weight, none)
        return np.maximum.accumulate(np.maximum(best, ends)), ends

    step = max(1, int(n**0.5))
    best, last = np.zeros(m + 1, np.int64), np.full(m + 1, none)
    saved = []
    for i in range(n):
        if i % step == 0:
            saved.append((best, last))
        best, last = row(i, best, last)
    out: list[tuple[int, int]] = []
    k, ending = m, False
    for s in range(len(saved) - 1, -1, -1):
        rows = [saved[s]]
        for i in range(s * step, min(n, s * step + step)):
            rows.append(row(i, *rows[-1]))
        for i in range(min(n, s * step + step) - 1, s * step - 1, -1):
            (best0, last0), (best1, last1) = rows[i - s * step], rows[i - s * step + 1]
            if not ending:
                if best0[k] == best1[k]:
                    continue
                k = int(np.searchsorted(best1, best1[k]))
            out.append((i, k - 1))
            ending = bool(near_a[i] and near_b[k - 1] and last0[k - 1] + 1 + weight == last1[k])
            k -= 1
    return out[::-1]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that increases in the first value (the second does already)."""
    from bisect import bisect_left

    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (x, _) in enumerate(pairs):
        p = bisect_left(ends, x)
        before[n] = at[p - 1] if p else -1
        if p == len(ends):
            ends.append(x), at.append(n)
        else:
            ends[p], at[p] = x, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def removed_lines(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]], min_chars: int = MIN_CHARS) -> list[int]:
    """Line numbers of b in common blocks; a line is (number among lines that are not blank,
    hash, characters)."""
    pairs = patience([x[1] for x in a], [x[1] for x in b], [x[0] for x in a], [x[0] for x in b])
    out: list[int] = []
    block: list[int] = []
    chars = 0
    for n, (i, k) in enumerate(pairs):
        if n and (a[i][0] != a[pairs[n - 1][0]][0] + 1 or b[k][0] != b[pairs[n - 1][1]][0] + 1):
            out += block if chars >= min_chars else []
            block, chars = [], 0
        block.append(b[k][0])
        chars += b[k][2]
    return out + (block if chars >= min_chars else [])


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, th and for each line that is not blank its number n among those, its number r among all
    lines, hash h and characters c."""

    def apply(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(2))
            for i, j in chunks(offsets):
                low = int(offsets[i])
                part, own = data[low : int(offsets[j])], offsets[i : j + 1] - low
                full = np.flatnonzero(SPACED[part])
                row_of = np.searchsorted(own, full, "right") - 1
                line_of = np.searchsorted(np.flatnonzero(part == 10), full) + row_of
                first = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1])) if len(full) else full
                last = np.append(first[1:] - 1, len(full) - 1) if len(full) else full
                starts, ends, row = full[first], full[last] + 1, row_of[first]
                n = np.arange(len(row)) - np.searchsorted(row, row)
                newlines = np.flatnonzero(part == 10)
                raw = np.searchsorted(newlines, starts) - np.searchsorted(newlines, own[row])
                chars = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
                at = pa.array(i + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(n.astype(np.int32)), pa.array(raw.astype(np.int32)), pa.array(span_hashes(part, starts, ends, fold=False).view(np.int64)), pa.array((chars[ends] - chars[starts]).astype(np.int32))],
                    names=["doc", "th", "n", "r", "h", "c"],
                )

    own = df.where(F.col(text).isNotNull()).select(*_identity(key, text), F.col(text).alias("text"))
    return own.mapInArrow(apply, "doc long, th long, n int, r int, h long, c int")


def _identity(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("th")]


def block_keys(lines: list[tuple[int, int, int, int, int]], min_chars: int = MIN_CHARS) -> list[int]:
    """Hashes of what leads a document to others besides single lines: its shortest runs of
    adjacent lines with min_chars characters, and following lines of one holder whose order
    is not the holder's. A line is (number, hash, characters, holder, number in the holder)."""
    if len(lines) < 2:
        return []
    n, h, c, o, p = (np.array(x, np.int64) for x in zip(*lines))
    h, size = h.view(np.uint64), len(lines)
    chars = np.append(0, np.cumsum(c))
    group = np.append(0, np.cumsum(np.diff(n) != 1))
    # runs from each line on, and back from each line
    ends = np.searchsorted(chars, chars[:-1] + min_chars)
    ok = (ends <= size) & (group[np.minimum(ends, size) - 1] == group)
    starts = np.searchsorted(chars, chars[1:] - min_chars, "right") - 1
    back = (starts >= 0) & (group[np.maximum(starts, 0)] == group)
    at = np.arange(size)
    first, last = np.append(at[ok], starts[back]), np.append(ends[ok], at[back] + 1)
    first, last = first[last > first + 1], last[last > first + 1]
    keys = [gram_hashes(h[i:j], j - i)[0] if j - i <= len(LANES) else whole_hash(h[i:j]) for i, j in sorted(set(zip(first.tolist(), last.tolist())))]
    # the sort is stable: lines of one holder stay in the document's order
    by = np.argsort(o, kind="stable")
    x, y = by[:-1], by[1:]
    turn = (o[x] == o[y]) & (p[x] > p[y])
    moved = mix(h[x[turn]] * LANES[0] + h[y[turn]] * LANES[1])
    return np.unique(np.append(np.array(keys, np.uint64), moved)).view(np.int64).tolist()


def _block_pairs(arrays: DataFrame, min_chars: int) -> DataFrame:
    """doc, th, first_doc, first_th: documents and the earliest ones that have a block key of theirs."""
    spark = arrays.sparkSession

    def apply(batches):
        for b in batches:
            found = [block_keys([(r["n"], r["h"], r["c"], r["o"], r["p"]) for r in x], min_chars) for x in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([k for x in found for k in x], pa.int64())], names=["doc", "th", "k"])

    keys = materialize(spark, arrays.select("doc", "th", "lines").mapInArrow(apply, "doc long, th long, k long"), "line-blocks")
    held = keys.groupBy("k").agg(F.min(F.struct("doc", "th")).alias("first"), F.max(F.struct("doc", "th")).alias("last"))
    held = held.where("first < last").select("k", F.col("first.doc").alias("first_doc"), F.col("first.th").alias("first_th"))
    held = materialize(spark, held, "line-blocks-first")
    return keys.join(held, "k").where("doc != first_doc or th != first_th").select("doc", "th", "first_doc", "first_th")


def removals(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, th and cut: numbers of the lines to delete (blank lines count, from 0), for documents
    that lose any."""
    spark = df.sparkSession
    lines = materialize(spark, lines_of(df, key, text), "lines")
    # the earliest document that holds a line, if a later one does too, and the line's place there
    held = lines.groupBy("h").agg(F.min(F.struct("doc", "th", "n")).alias("first"), F.max(F.struct("doc", "th")).alias("last"))
    shared = held.where("struct(first.doc, first.th) < last").select("h", F.col("first.doc").alias("first_doc"), F.col("first.th").alias("first_th"), F.col("first.n").alias("first_n"))
    # written first: a join of two fresh exchanges can be split where one line is very common
    shared = materialize(spark, shared, "lines-first")
    linked = materialize(spark, lines.join(shared, "h"), "lines-shared")
    discard(lines, shared)
    holder = F.xxhash64("first_doc", "first_th").alias("o")
    arrays = linked.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("n", "h", "c", "r", holder, F.col("first_n").alias("p")))).alias("lines"))
    arrays = materialize(spark, arrays, "lines-by-document")
    pairs = linked.where("doc != first_doc or th != first_th").select("doc", "th", "first_doc", "first_th")
    pairs = materialize(spark, pairs.union(_block_pairs(arrays, min_chars)).distinct(), "line-pairs")
    discard(linked)
    return aligned(arrays, pairs, min_chars)


def aligned(arrays: DataFrame, pairs: DataFrame, min_chars: int, share: int | None = None) -> DataFrame:
    """doc, th and cut from the lines of documents and the pairs to align. The lines of an
    earlier document travel once for each share of its pairs and not with each pair; its shares
    go to different tasks, and a task holds one earlier document at a time."""
    first = ["first_doc", "first_th"]
    per = pairs.groupBy(*first).agg(F.ceil(F.count("*") / (share or SHARE)).cast("int").alias("shares"))
    earlier = arrays.select(F.col("doc").alias("first_doc"), F.col("th").alias("first_th"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("th"), "lines").join(per, first)
    earlier = earlier.select(*first, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "doc", "th", "lines")
    later = pairs.join(per, first).join(arrays, ["doc", "th"]).select(*first, F.pmod(F.xxhash64("doc", "th"), "shares").cast("int").alias("share"), "doc", "th", "lines")
    groups = [*first, "share"]
    both = earlier.union(later).repartition(*groups).sortWithinPartitions(*groups, F.col("doc").asc_nulls_first(), "th")

    def align(batches):
        lines: list[tuple[int, int, int]] = []
        places: dict[int, list[int]] = {}
        for b in batches:
            docs, ths, cuts = [], [], []
            for doc, th, found in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), b.column("lines")):
                found = found.as_py()
                own = [(x["n"], x["h"], x["c"]) for x in found]
                if doc is None:
                    lines, places = own, {}
                    for i, x in enumerate(own):
                        places.setdefault(x[1], []).append(i)
                    continue
                # lines that only one of the two has are in no gap's alignment
                common = sorted(i for h in {x[1] for x in own} for i in places.get(h, ()))
                raw = {x["n"]: x["r"] for x in found}
                cut = removed_lines([lines[i] for i in common], [x for x in own if x[1] in places], min_chars)
                if cut:
                    docs.append(doc), ths.append(th), cuts.append([raw[n] for n in cut])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ths, pa.int64()), pa.array(cuts, pa.list_(pa.int32()))], names=["doc", "th", "cut"])

    found = both.mapInArrow(align, "doc long, th long, cut array<int>")
    return found.groupBy("doc", "th").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def apply_removals(df: DataFrame, cuts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df as a struct column "row", with "n_cut" and "kept", the text without the lines cut."""
    doc, th = _identity(key, text)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), doc, th)
    # the small side is hashed: the texts are moved once and not sorted
    joined = rows.join(cuts.hint("shuffle_hash"), ["doc", "th"], "left")
    # a column of its own, which the lookups below read and do not split again
    parted = joined.select("row", "cut", F.when(F.col("cut").isNotNull(), F.split(F.col(f"row.`{text}`"), "\n", -1)).alias("parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("cut"))
    kept = F.when(F.col("cut").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n"))
    return parted.select("row", F.coalesce(F.size("cut"), F.lit(0)).alias("n_cut"), kept.alias("kept"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", drop_empty: bool = True, min_chars: int = MIN_CHARS) -> DataFrame:
    """df with common blocks deleted from later documents. drop_empty: documents that lose
    lines and have no other left go."""
    done = apply_removals(df, removals(df, key, text, min_chars), key, text)
    if drop_empty:
        done = done.where((F.col("n_cut") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return done.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def report(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines that are not blank, how many are deleted, and a digest of the rest."""
    done = apply_removals(df, removals(df, key, text, min_chars), key, text)
    lines = F.size(F.filter(F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return done.select(F.col(f"row.`{key}`").cast("long").alias("doc_id"), lines.cast("long").alias("n_lines"), F.col("n_cut").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
