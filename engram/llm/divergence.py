"""Source divergence audit: how far the sources of a language differ in their words.

Terms are counted in an Arrow pass, summed by (lang, source, term), and kept where enough
documents of the language have them. A group's share of a term is an integer,
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), and two groups differ in a term by
f = |p - q|. Since f depends on the two counts alone, a pair of sources is told by its joint
histogram: how many terms have each combination of counts. Buckets of terms tally the
combinations in which both counts are positive; those with a zero follow from each source's own
histogram less the tallied ones, and (0, 0) from the number of terms. f is evaluated once a
combination and multiplied, so the arithmetic does not grow with the vocabulary.

All arithmetic is exact (decimals of 38 digits). Each row is a document, also a repeated one.
Defined results: null text, lang and source are ''; a text without terms still makes its
group; a language without kept terms has V = 0, pairs of value 0 and no terms; ties rank by
item in UTF-8 order; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, materialize, partitions_for, text_buffer, trim, word_spans

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text counted at a time; rows of a bucket of terms; pairs held at a time.
CHUNK, BUCKET_ROWS, PAIRS = 4 << 20, 400_000, 4_000_000

#: Bytes of terms: letters and everything beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it); a null term stands for
    the group itself, its docs are the group's documents. Sums of parts, not yet by key."""

    def count(batches):
        for b in batches:
            lang, langs = _codes(b.column(1))
            source, sources = _codes(b.column(2))
            group = lang * len(sources) + source
            known, group = np.unique(group, return_inverse=True)
            at_lang, at_source = known // max(1, len(sources)), known % max(1, len(sources))

            def rows(g, terms, n, docs):
                return pa.RecordBatch.from_arrays([langs.take(pa.array(at_lang[g])), sources.take(pa.array(at_source[g])), terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

            yield rows(np.arange(len(known)), pa.nulls(len(known), pa.string()), np.zeros(len(known), np.int64), np.bincount(group, minlength=len(known)).astype(np.int64))
            data, offsets = text_buffer(b.column(0))
            for i, j in chunks(offsets, CHUNK):
                low = int(offsets[i])
                part = data[low : int(offsets[j])]
                starts, ends, first = word_spans(part, offsets[i : j + 1] - low, LETTER)
                if not len(starts):
                    continue
                edges = np.concatenate([[0], np.cumsum(ends - starts)])
                letters = _FOLD[part[LETTER[part]]]
                words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
                code, width = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
                row = np.repeat(np.arange(j - i), np.diff(first))
                once = np.unique(row * width + code)  # a document's terms
                place, n = np.unique(group[i + row] * width + code, return_counts=True)
                docs = np.unique(group[i + once // width] * width + once % width, return_counts=True)[1]
                for k in range(0, len(place), 50_000):
                    at = place[k : k + 50_000]
                    yield rows(at // width, words.dictionary.take(pa.array(at % width)).cast(pa.string()), n[k : k + 50_000].astype(np.int64), docs[k : k + 50_000].astype(np.int64))
        trim()

    named = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in ((text, "text"), (lang, "lang"), (source, "source"))])
    return named.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _tally(table: pa.Table) -> pa.Table:
    """Of a bucket of terms: lang, sources a < b, the counts of both, and how many terms have
    them, for counts above zero."""
    table = table.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]).combine_chunks()
    coded = {c: _codes(table.column(c)) for c in ("lang", "source", "term")}
    (lang, langs), (source, sources), (term, _) = (coded[c] for c in ("lang", "source", "term"))
    n = table.column("n").to_numpy()
    heads = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))[: len(term)])
    size = np.diff(np.append(heads, len(term)))
    after = np.repeat(heads + size, size) - np.arange(len(term)) - 1  # partners that follow
    reach, out, i = np.cumsum(after), [], 0
    while i < len(term):  # entries as left sides, in blocks of so many pairs
        j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + PAIRS, "right")))
        left = np.repeat(np.arange(i, j), after[i:j])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after[i:j]) - after[i:j], after[i:j])
        cells = np.stack([lang[left], source[left], source[right], n[left], n[right]], 1)
        cells = cells[np.lexsort(cells.T[::-1])]
        first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1))[: len(cells)])
        out.append(np.column_stack([cells[first], np.diff(np.append(first, len(cells)))]))
        i = j
    trim()
    cells = np.concatenate(out) if out else np.zeros((0, 6), np.int64)
    names = [langs.take(pa.array(cells[:, 0])), sources.take(pa.array(cells[:, 1])), sources.take(pa.array(cells[:, 2]))]
    return pa.Table.from_arrays([*names, *[pa.array(np.ascontiguousarray(cells[:, k])) for k in (3, 4, 5)]], names=["lang", "a", "b", "ca", "cb", "terms"])


def _codes(column) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, and the values."""
    found = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)); null where the divisor is 0."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * ({wide(count)} + {PRIOR}) div nullif({wide(total)} + {PRIOR} * {wide(terms)}, 0)")


def kept_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms). groups: lang, source, total (occurrences of kept terms), lang_total, v
    (kept terms of the language). terms: lang, source, term, n, lang_n."""
    spark = df.sparkSession
    counts = materialize(spark, term_counts(df, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    word = Window.partitionBy("lang", "term")
    seen = counts.where("term is not null").select("*", F.sum("docs").over(word).alias("lang_docs"), F.sum("n").over(word).alias("lang_n"), F.min("source").over(word).alias("first"))
    terms = materialize(spark, seen.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).alias("head")), "divergence-terms")
    of_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("head").cast("long")).alias("v"))
    named = counts.where("term is null").select("lang", "source")
    groups = named.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "v"])
    return materialize(spark, groups, "divergence-groups"), terms.drop("head")


def _pair_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b), value."""
    buckets = max(partitions_for(groups.sparkSession), terms.count() // BUCKET_ROWS)
    tally = terms.select("lang", "source", "term", "n").groupBy(F.pmod(F.xxhash64("lang", "term"), F.lit(buckets))).applyInArrow(_tally, "lang string, a string, b string, ca long, cb long, terms long")
    both = tally.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("terms").alias("terms"))
    x, y = (groups.select("lang", F.col("source").alias(k), F.col("total").alias(f"total_{k}"), "v") for k in "ab")
    pairs = materialize(groups.sparkSession, x.join(y.drop("v"), "lang").where("a < b"), "divergence-pairs")
    own = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    # what the tally and the sources' own histograms say about every combination, zeros by difference
    cell = lambda ca, cb, m: F.struct(ca.cast("long").alias("ca"), cb.cast("long").alias("cb"), m.cast("long").alias("m"))
    zero, ca, cb, m = F.lit(0), F.col("ca"), F.col("cb"), F.col("terms")
    told = both.select("lang", "a", "b", F.inline(F.array(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m))))
    keys = pairs.select("lang", "a", "b")
    left = keys.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.inline(F.array(cell(F.col("n"), zero, m), cell(zero, zero, -m))))
    right = keys.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.inline(F.array(cell(zero, F.col("n"), m), cell(zero, zero, -m))))
    none = pairs.select("lang", "a", "b", F.inline(F.array(cell(zero, zero, F.col("v")))))
    cells = told.unionByName(left).unionByName(right).unionByName(none).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m != 0")
    f = F.abs(_share("ca", "total_a", "v") - _share("cb", "total_b", "v"))
    sums = cells.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(f.cast("decimal(20,0)") * F.col("m")).alias("value"))
    return keys.join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part 'pair': every other source of the language
    by divergence; part 'term': the terms the source has most above its language's share."""
    groups, terms = kept_terms(df, text, lang, source, min_docs)
    values = materialize(df.sparkSession, _pair_values(groups, terms), "divergence-values")
    pairs = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(values.select("lang", "b", "a", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = terms.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (_share("n", "total", "v") - _share("lang_n", "lang_total", "v")).cast("long").alias("value")).where("value > 0")
    best = above.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return pairs.union(best)
