"""LM scoring with a probabilistic suffix tree (PST) over the running tokens of the texts.

A state of the tree is a context of up to DEPTH preceding tokens, the text's beginning among
them. A context is a candidate from MIN_COUNT occurrences in the training texts on, a fixed
number, so the tree grows with the corpus. It is retained by a divergence test: over all its
occurrences, its next-token distribution must predict the tokens that follow 10 ** GAIN times
better than that of its suffix does, each token being predicted from all the other occurrences. A
distribution is smoothed with the next shorter retained suffix's, which counts as WEIGHTS
occurrences, down to the one without a context. There a word has its absolutely discounted
share, interpolated with the probability of its spelling. Every token of every text is scored
from its longest retained suffix. The probabilities of what can follow a context sum to 1.

Spellings come from a second, small suffix tree over the bytes of words, which learns each
distinct word once, rounded to 1 / SPELL_UNIT. Its contexts make up at least P_MIN of all its predictions, which bounds
it whatever the corpus: it only tells words that never or seldom occur.

The texts are cut into chunks of about PLACES tokens, long texts into several pieces, and
each chunk numbers its distinct sequences. Their hashes go to buckets with the chunk's counts
and come back with those of the corpus, one length after the other; only sequences that extend
a candidate are asked for. A sequence goes once for each chunk that has it, however frequent it
is. Gains take the same way. No table of sequences is collected or broadcast. Words and
sequences are told apart by 64-bit hashes; sequences are numbered in their order, so that what
is sent and what comes back is in order too.

Word counts come from all training rows and are aggregated before the shuffle. The spellings
of the HEAD most frequent words are broadcast; those of all others are found where they occur.

Defined results: null and empty texts have the end token alone; a null key counts as the
empty string, so such rows are held out; repeated rows are each counted and reported; without
training rows every distribution is uniform; other columns are not looked at. A text of any
length is scored whole; ties among frequent words do not change a result.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _BYTE, LANES, SPACED, U64, chunks, discard, materialize, mix, powers, release, span_hashes, text_buffer, trim, word_spans

#: Tokens of a context at most, its least occurrences, what it must gain (in log10), and by depth the weight of its suffix's distribution.
DEPTH, MIN_COUNT, GAIN, WEIGHTS = 2, 2, 1.0, (400.0, 20.0)
#: Tokens of a chunk; a gain's unit is 1 / UNIT of log10.
PLACES, UNIT = 1_000_000, 64
#: Sequences of a bucket, about.
BUCKET = 1_500_000
#: The spelling tree: bytes of a context, least share of all predictions, test; words that are broadcast.
SPELL_DEPTH, P_MIN, G_TEST, HEAD, SPELL_UNIT = 4, 5e-5, 6.0, 1 << 19, 64
#: Symbols that can follow: 256 bytes (the space ends a word) and the end of the text.
END, SYMBOLS = 256, 257
#: Words, and bytes of words, that a task counts before it passes them on.
FLUSH, FLUSH_BYTES = 300_000, 1 << 25
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 10 == 0


# ---------------------------------------------------------------------- counts


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each span."""
    size = ends - starts
    edges = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(taken)])


def _counted(parts: list) -> pa.RecordBatch:
    """parts: distinct words, their hashes and counts of some texts each."""
    h, at, number = distinct(np.concatenate([p[1] for p in parts]))
    c = np.zeros(len(h), np.int64)
    np.add.at(c, number, np.concatenate([p[2] for p in parts]))
    words = pa.concat_arrays([p[0] for p in parts]).take(pa.array(at)).cast(pa.binary())
    return pa.RecordBatch.from_arrays([words, pa.array(h.view(np.int64)), pa.array(c)], names=["word", "h", "c"])


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, its hash h and its count c over all rows."""

    def apply(batches):
        parts, held, room = [], 0, 0
        for b in batches:
            data, offsets = text_buffer(b.column(0))
            for i, j in chunks(offsets):
                low = int(offsets[i])
                part = _fold(data[low : int(offsets[j])])
                starts, ends, _ = word_spans(part, offsets[i : j + 1] - low, SPACED)
                h, at, number = distinct(span_hashes(part, starts, ends))
                parts.append((_cut(part, starts[at], ends[at]), h, np.bincount(number, minlength=len(h))))
                held, room = held + len(h), room + parts[-1][0].nbytes
                if held > FLUSH or room > FLUSH_BYTES:
                    yield _counted(parts)
                    parts, held, room = [], 0, 0
        if held:
            yield _counted(parts)

    partial = df.select(text).mapInArrow(apply, "word binary, h long, c long")
    return partial.groupBy("word", "h").agg(F.sum("c").alias("c"))


# ------------------------------------------------------------------- spellings


def layout(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words with a space before and after: symbols, for each place how many precede it in its
    word (0 for the leading space), and the number of its word."""
    size = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(starts)), size)
    within = np.arange(first[-1]) - first[:-1][word]
    symbols = np.full(first[-1], 32, np.uint8)
    inner = (within > 0) & (within < size[word] - 1)
    symbols[inner] = data[(starts[word] + within - 1)[inner]]
    return symbols, within, word


class Contexts:
    """Hashes of the d symbols before each place."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        p, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[symbols] * p[:n], out=self.sums[1:])

    def of(self, places: np.ndarray, d: int) -> np.ndarray:
        return mix((self.sums[places] - self.sums[places - d]) * self.inverse[places - d] + LANES[d])


class Keys:
    """Sorted distinct hashes. Their leading bits tell where to look, which a search by halves
    finds out with a cache miss a step."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(22, len(keys).bit_length() + 1)
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index in keys, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        last = len(self.keys) - 1
        at = np.minimum(self.first[wanted >> self.shift], last).astype(np.int64)
        there = self.keys[at]
        rest = np.flatnonzero(there < wanted)
        while len(rest):
            rest = rest[at[rest] < last]
            at[rest] += 1
            there[rest] = self.keys[at[rest]]
            rest = rest[there[rest] < wanted[rest]]
        at[there != wanted] = -1
        return at


def _level(counts: DataFrame, d: int, parents: Keys | None) -> DataFrame:
    """ctx, parent, sym, c for contexts of d symbols, one at least, that extend one of parents."""
    shared = counts.sparkSession.sparkContext.broadcast(parents)
    following = mix(np.arange(256, dtype=np.uint64) + LANES[10])

    def apply(batches):
        for b in batches:
            known = shared.value
            data, offsets = text_buffer_binary(b.column(0))
            for i, j in chunks(offsets):
                low = int(offsets[i])
                symbols, within, _ = layout(data[low : int(offsets[j])], offsets[i:j] - low, offsets[i + 1 : j + 1] - low)
                places = np.flatnonzero(within >= d)
                own = Contexts(symbols)
                if d > 1:
                    up = own.of(places, d - 1)
                    held = known.find(up) >= 0
                    places, up = places[held], up[held]
                else:
                    up = np.zeros(len(places), np.uint64)
                here = own.of(places, d)
                sym = symbols[places]
                _, at, number = distinct(here + following[sym])
                c = np.bincount(number, minlength=len(at))
                yield pa.RecordBatch.from_arrays([pa.array(here[at].view(np.int64)), pa.array(up[at].view(np.int64)), pa.array(sym[at].astype(np.int32)), pa.array(c.astype(np.int64))], names=["ctx", "parent", "sym", "c"])

    found = counts.select("word").mapInArrow(apply, "ctx long, parent long, sym int, c long")
    return found.groupBy("ctx", "parent", "sym").agg(F.sum("c").alias("c"))


def text_buffer_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(column.cast(pa.large_binary()).cast(pa.large_string()) if pa.types.is_binary(column.type) else column)


class SuffixTree:
    """Retained contexts, sorted by depth and hash; state 0 is the empty context."""

    def __init__(self):
        self.depth_keys: list[Keys] = []  # by depth from 1
        self.depth_first: list[int] = []  # state of the first
        self.parent = np.zeros(1, np.int64)
        self.back = np.zeros(1)  # log10 of the weight that goes to the suffix
        self.keys = Keys(np.zeros(0, np.uint64))  # of (state, symbol)
        self.logp = np.zeros(0)

    @staticmethod
    def key(state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        # distinct pairs stay distinct: the factor is odd
        return (state.astype(np.uint64) * U64(512) + sym.astype(np.uint64)) * LANES[11]

    @classmethod
    def build(cls, levels: list[dict[int, tuple[int, dict[int, int]]]], ends: int, depth: int = SPELL_DEPTH, g_test: float = G_TEST) -> SuffixTree:
        """levels[d]: context hash -> (hash of its suffix, counts of next symbols)."""
        tree = cls()
        begin = int(mix(_BYTE[32:33] + LANES[1])[0])
        if levels and levels[0] and ends:
            levels[0][0][1][END] = ends
        if len(levels) > 1 and begin in levels[1] and ends:
            levels[1][begin][1][END] = ends
        probability: list[dict[int, dict[int, float]]] = []
        total0 = sum(levels[0][0][1].values()) if levels and levels[0] else 0
        root = levels[0][0][1] if levels and levels[0] else {}
        b0 = max(1, len(root))
        p0 = {s: (c + b0 / SYMBOLS) / (total0 + b0) for s, c in root.items()}
        default0 = (b0 / SYMBOLS) / (total0 + b0)
        smoothed: dict[tuple[int, int], tuple[dict[int, float], float]] = {(0, 0): (p0, b0 / (total0 + b0))}
        keep: list[set[int]] = [set() for _ in levels]

        def prob(d: int, ctx: int, s: int) -> float:
            factor = 1.0
            while d > 0:
                p, back = smoothed[d, ctx]
                if s in p:
                    return factor * p[s]
                factor *= back
                d, ctx = d - 1, levels[d][ctx][0]
            return factor * p0.get(s, default0)

        for d in range(1, len(levels)):
            for ctx, (up, following) in levels[d].items():
                total, b = sum(following.values()), len(following)
                before = {s: prob(d - 1, up, s) for s in following}
                smoothed[d, ctx] = ({s: (c + b * before[s]) / (total + b) for s, c in following.items()}, b / (total + b))
                gain = sum(c * np.log(c / total / before[s]) for s, c in following.items())
                if 2 * gain > g_test * max(1, b):
                    keep[d].add(ctx)
        for d in range(len(levels) - 1, 1, -1):
            keep[d - 1] |= {levels[d][ctx][0] for ctx in keep[d]}
        state = {(0, 0): 0}
        parent, back = [0], [np.log10(b0 / (total0 + b0))]
        entries = [(0, s, np.log10(p)) for s, p in p0.items()]
        for d in range(1, len(levels)):
            ordered = sorted(keep[d])
            tree.depth_keys.append(Keys(np.array(ordered, dtype=np.uint64)))
            tree.depth_first.append(len(parent))
            for ctx in ordered:
                up = levels[d][ctx][0]
                me = state[d, ctx] = len(parent)
                parent.append(state[d - 1, up if d > 1 else 0])
                p, w = smoothed[d, ctx]
                back.append(np.log10(w))
                entries += [(me, s, np.log10(x)) for s, x in p.items()]
        keys = cls.key(np.array([e[0] for e in entries], dtype=np.int64), np.array([e[1] for e in entries], dtype=np.int64)) if entries else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        tree.keys, tree.logp = Keys(keys[order]), np.array([e[2] for e in entries])[order] if entries else np.zeros(0)
        tree.parent, tree.back = np.array(parent), np.array(back)
        tree.end_logp = float(tree._predict(np.array([state.get((1, begin), 0)]), np.array([END]))[0])
        return tree

    def _predict(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state))
        rest = np.arange(len(state))
        state = state.copy()
        while len(rest):
            at = self.keys.find(self.key(state[rest], sym[rest]))
            hit = at >= 0
            out[rest[hit]] += self.logp[at[hit]]
            rest = rest[~hit]
            out[rest] += self.back[state[rest]]
            bottom = state[rest] == 0
            out[rest[bottom]] -= np.log10(SYMBOLS)
            rest = rest[~bottom]
            state[rest] = self.parent[state[rest]]
        return out

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each word and its end."""
        if not len(starts):
            return np.zeros(0)
        symbols, within, word = layout(data, starts, ends)
        places = np.flatnonzero(within > 0)
        own = Contexts(symbols)
        state = np.zeros(len(places), np.int64)
        alive = np.arange(len(places))
        for d, (keys, first) in enumerate(zip(self.depth_keys, self.depth_first), 1):
            alive = alive[within[places[alive]] >= d]
            if not len(alive) or not len(keys):
                break
            at = keys.find(own.of(places[alive], d))
            alive, at = alive[at >= 0], at[at >= 0]
            state[alive] = first + at
        return np.bincount(word[places], weights=self._predict(state, symbols[places].astype(np.int64)), minlength=len(starts))


def fit(counts: DataFrame, ends: int, depth: int = SPELL_DEPTH, p_min: float = P_MIN, g_test: float = G_TEST) -> SuffixTree:
    """Grows the candidates one symbol at a time; each level holds at most 1/p_min contexts.
    Contexts of one symbol, 256 at most, tell those of none."""
    levels: list[dict[int, tuple[int, dict[int, int]]]] = []
    known, least = None, 0.0
    for d in range(1, max(1, depth) + 1):
        if d > 1 and not len(known):
            break
        found = _level(counts, d, known)
        rows = found.groupBy("ctx", "parent").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("sym", "c"))).alias("m")).where(F.col("n") >= least).collect()
        if d == 1:
            root: Counter = Counter()
            for r in rows:
                root.update(r.m)
            levels.append({0: (0, dict(root))} if rows else {})
            least = max(2.0, p_min * sum(r.n for r in rows))
        level = {r.ctx % (1 << 64): (r.parent % (1 << 64), dict(r.m)) for r in rows if r.n >= least}
        levels.append(level)
        known = Keys(np.array(sorted(level), dtype=np.uint64))
    return SuffixTree.build(levels[: depth + 1], ends, depth, g_test)


# ------------------------------------------------------------------------ words


class Lookup:
    """Spellings of words, kept for the most frequent ones, and probabilities without a context.
    words: in the order of their numbers, the most frequent first."""

    def __init__(self, words: list[bytes], tree: SuffixTree, total: float, discount: float, distinct: float):
        self.tree, self.total, self.discount, self.distinct = tree, total, discount, distinct
        edges = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        joined = np.frombuffer(b"".join(words), np.uint8)
        self.hashes, self.score = np.empty(len(words), np.uint64), np.empty(len(words))
        for i, j in chunks(edges, 1 << 18):
            part, a, b = joined[edges[i] : edges[j]], edges[i:j] - edges[i], edges[i + 1 : j + 1] - edges[i]
            self.hashes[i:j], self.score[i:j] = span_hashes(part, a, b), rounded(tree.score(part, a, b)) / SPELL_UNIT
        self.number = np.argsort(self.hashes)
        self.keys = Keys(self.hashes[self.number])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words that are kept, -1 for others."""
        at = self.keys.find(hashes)
        return np.where(at >= 0, self.number[at] if len(self.number) else -1, -1)

    def word(self, c, spelled: np.ndarray) -> np.ndarray:
        """log10 probability of words with counts c and spellings' log10 probabilities."""
        if not self.total:
            return spelled
        # far below what a float can hold, log10(x * 10**s) is taken apart
        rest = np.log10(self.discount * self.distinct / self.total) + spelled
        seen = np.maximum(np.asarray(c, float) - self.discount, 0) / self.total
        return np.where(seen > 0, np.log10(seen + 10.0 ** np.maximum(rest, -300)), rest)


def rounded(x: np.ndarray) -> np.ndarray:
    """Spellings' log10 probabilities in units of 1 / SPELL_UNIT."""
    return np.rint(x * SPELL_UNIT).astype(np.int64)


def _fold(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def frequent(counts: DataFrame, head: int) -> DataFrame:
    """The most frequent words, head at most: those above a step of the counts' histogram, so
    that no task orders all words."""
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, n in steps:
        if total + n > head:
            break
        total, least = total + n, s
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)


# ------------------------------------------------------------------ sequences


_HEADER, _ZSTD = struct.Struct("<qqB"), pa.Codec("zstd")


def packed(x: np.ndarray) -> bytes:
    """Integers above their least as byte planes, as many as they need, compressed: small values
    and steps take few bytes."""
    n = len(x)
    if not n:
        return b""
    x = np.asarray(x, np.int64)
    low = x.min()
    above = (x - low).view(np.uint64)
    width = (int(above.max()).bit_length() + 7) // 8
    planes, source = np.empty(width * n, np.uint8), above.view(np.uint8)
    for k in range(width):
        planes[k * n : (k + 1) * n] = source[k::8]
    return _HEADER.pack(n, low, width) + (_ZSTD.compress(planes, asbytes=True) if width else b"")


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    n, low, width = _HEADER.unpack_from(raw)
    out = np.zeros(n, np.int64)
    if width:
        planes, target = np.frombuffer(_ZSTD.decompress(memoryview(raw)[_HEADER.size :], width * n), np.uint8), out.view(np.uint8)
        for k in range(width):
            target[k::8] = planes[k * n : (k + 1) * n]
    out += low
    return out


def ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of hashes, and the hashes in it. They are sorted as numbers whose last bits are the place, much faster than
    places by their hashes; should the bits left of two hashes not tell them apart, it is done so."""
    n = len(h)
    if n < 2 or (h[1:] >= h[:-1]).all():
        return np.arange(n), h
    bits, same = U64(n.bit_length()), U64(64 - (int(h.min()) ^ int(h.max())).bit_length())
    x = (h << same) >> bits << bits
    x |= np.arange(n, dtype=np.uint64)
    x.sort()
    x &= (U64(1) << bits) - U64(1)
    order = x.view(np.int64)
    there = h[order]
    if not (there[1:] >= there[:-1]).all():
        order = np.argsort(h)
        there = h[order]
    return order, there


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and for every one its number."""
    order, there = ordered(h)
    fresh = np.append(True, there[1:] != there[:-1])[: len(h)]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return there[fresh], number


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values as they first come, a place of each, and for every value its number."""
    number, values = pd.factorize(x)
    at = np.empty(len(values), np.int64)
    at[number[::-1]] = np.arange(len(x) - 1, -1, -1)
    return values, at, number


#: Numbers of the text's beginning and end among a chunk's words.
BEGIN, STOP = 0, 1
_MARKS = mix(np.array([3, 5], np.uint64))


class Chunk:
    """Tokens of some texts or pieces of texts. A piece has lead tokens, which are contexts only
    (the text's beginning, or the last tokens of the piece before), and then its own."""

    def __init__(self, fields: dict[str, np.ndarray]):
        self.__dict__.update(fields)
        n = len(self.token)
        starts = np.cumsum(self.size) - self.size
        self.first = np.zeros(n, bool)
        self.first[starts] = True
        self.own = np.ones(n, bool)
        for k in range(int(self.lead.max(initial=0))):
            self.own[starts[self.lead > k] + k] = False
        learnt = np.repeat((self.train & 1).astype(bool), self.size)
        self.counted = learnt & (self.own | (self.token == BEGIN))
        self.learnt = learnt & self.own
        self.ids: list[np.ndarray] = []  # by length: number of the sequence that ends at each place, -1 for none
        self.keys: list[np.ndarray] = []  # its hash; but for single tokens, sequences are numbered by hash
        self.counts: list[np.ndarray] = []  # how often the training texts have it

    def grow(self) -> None:
        """Sequences one token longer, of those whose beginning has MIN_COUNT occurrences."""
        if not self.ids:
            self.ids.append(self.token)
            self.keys.append(self.word)
            return
        before = np.append(-1, self.ids[-1][:-1])
        before[self.first] = -1
        if len(self.counts) == len(self.ids):
            at = np.flatnonzero(np.append(self.counts[-1] >= MIN_COUNT, False)[before])
        else:
            at = np.flatnonzero(before >= 0)
        up, last = self.keys[-1] * LANES[20] + U64(len(self.keys)), self.keys[0] * LANES[21]
        keys, number = numbered(mix(up[before[at]] + last[self.token[at]]))
        out = np.full(len(before), -1)
        out[at] = number
        self.ids.append(out)
        self.keys.append(keys)

    def occurrences(self, k: int) -> np.ndarray:
        own = self.counted & (self.ids[k] >= 0)
        return np.bincount(self.ids[k][own], minlength=len(self.keys[k]))

    def contexts(self, d: int, kept: np.ndarray | None = None):
        """Own places with a context of d tokens that counts: place, context, sequence with the next token."""
        before = np.append(-1, self.ids[d - 1][:-1])
        before[self.first] = -1
        good = self.counts[d - 1] >= MIN_COUNT if kept is None else kept
        at = np.flatnonzero(self.own & (before >= 0) & (self.ids[d] >= 0))
        at = at[good[before[at]]]
        return at, before[at], self.ids[d][at]

    def unigrams(self, model: Lookup, less: int = 0) -> np.ndarray:
        c = self.counts[0]
        out = model.word(c, self.spelled)[self.token]
        if less:
            out[self.learnt] = model.word(c - less, self.spelled)[self.token[self.learnt]]
        return out

    def step(self, score: np.ndarray, d: int, at, up, seq, less: int = 0) -> np.ndarray:
        """log10 probabilities with the contexts of d tokens taken into account."""
        mass = WEIGHTS[min(d, len(WEIGHTS)) - 1]
        c = self.counts[d][seq] - less * self.learnt[at]
        n = self.counts[d - 1][up] - less * self.learnt[at]
        out = score.copy()
        p = score[at] + np.log10(mass)
        p = np.where(c > 0, np.log10(c + 10.0 ** np.maximum(p, -300)), p)
        out[at] = p - np.log10(n + mass)
        return out

    def gains(self, model: Lookup) -> list[np.ndarray]:
        """By depth, for each context: what it adds to the log probability of the tokens that
        follow it in the training texts, each predicted from all other occurrences."""
        score, out = self.unigrams(model, 1), []
        for d in range(1, len(self.keys)):
            at, up, seq = self.contexts(d)
            better = self.step(score, d, at, up, seq, 1)
            own = self.learnt[at]
            gain = np.rint((better[at] - score[at]) * UNIT).astype(np.int64)
            total = np.bincount(up[own], weights=gain[own], minlength=len(self.keys[d - 1]))
            out.append(total.astype(np.int64))
            score = better
        return out

    def scores(self, model: Lookup, retained: list[np.ndarray]) -> np.ndarray:
        """log10 probabilities of the tokens; retained: by depth, which contexts are states."""
        score = self.unigrams(model)
        for d, kept in enumerate(retained, 1):
            score = self.step(score, d, *self.contexts(d, kept))
        return score


_FIELDS = ["token", "known", "others", "spelled", "row", "doc", "size", "lead", "train"]
_CHUNK = "chunk long, " + ", ".join(f"{f} binary" for f in _FIELDS)


def chunked(df: DataFrame, key: str, text: str, train, shared, depth: int, limit: int = PLACES) -> DataFrame:
    """Chunks of about limit tokens; longer texts are in several pieces."""

    def flush(number: int, parts: list) -> pa.RecordBatch:
        hashes, spelled = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        word, at, back = distinct(hashes)
        low, tokens = 0, []
        for h, _, t, *_ in parts:
            # words are numbered in the part, the marks are not
            tokens.append(np.concatenate([[BEGIN, STOP], back[low : low + len(h)] + 2])[t])
            low += len(h)
        # words that are kept come first, by number, which says all of them; then the others by hash
        kept = shared.value.find(word)
        inside, others = np.flatnonzero(kept >= 0), np.flatnonzero(kept < 0)
        order = np.concatenate([inside[np.argsort(kept[inside])], others[ordered(word[others])[0]]])
        known = len(inside)
        rank = np.empty(len(order) + 2, np.int64)
        rank[:2], rank[order + 2] = [BEGIN, STOP], np.arange(len(order)) + 2
        fields = {
            "token": rank[np.concatenate(tokens)],
            "known": np.diff(kept[order[:known]], prepend=0),
            "others": np.diff(word[order[known:]], prepend=U64(0)).view(np.int64),
            "spelled": spelled[at[order[known:]]],
            **{f: np.concatenate([p[3 + k] for p in parts]) for k, f in enumerate(_FIELDS[4:])},
        }
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([packed(fields[f])], pa.binary()) for f in _FIELDS]], names=["chunk", *_FIELDS])

    def apply(batches):
        tool, number, row = shared.value, TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        parts, held = [], 0
        for b in batches:
            data, offsets = text_buffer(b.column(2))
            ids, learnt = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False) + 2 * b.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                low = int(offsets[i])
                part = _fold(data[low : int(offsets[j])])
                starts, ends, first = word_spans(part, offsets[i : j + 1] - low, SPACED)
                hashes, one, back = distinct(span_hashes(part, starts, ends))
                spelled, rest = np.zeros(len(hashes), np.int64), np.flatnonzero(tool.keys.find(hashes) < 0)
                spelled[rest] = rounded(tool.tree.score(part, starts[one[rest]], ends[one[rest]]))
                words = hashes, spelled
                for r in range(i, j):
                    own = np.concatenate([[BEGIN], back[first[r - i] : first[r - i + 1]] + 2, [STOP]])
                    # pieces share depth tokens with the one before
                    for a in range(1, len(own), limit):
                        lead = min(a, depth)
                        parts.append((own[a - lead : a + limit], lead, row, ids[r], learnt[r], words))
                        held += min(limit, len(own) - a)
                        if held >= limit:
                            yield flush(number, grouped(parts))
                            number, parts, held = number + 1, [], 0
                    row += 1
        if parts:
            yield flush(number, grouped(parts))

    def grouped(parts: list) -> list:
        """Pieces that share word numbers, together."""
        out, n = [], 0
        while n < len(parts):
            m = n
            while m < len(parts) and parts[m][5] is parts[n][5]:
                m += 1
            some = parts[n:m]
            hashes, spelled = some[0][5]
            tokens = np.concatenate([p[0] for p in some])
            used = np.zeros(len(hashes) + 2, bool)
            used[tokens] = used[:2] = True
            number = np.cumsum(used) - 1
            sizes = np.array([len(p[0]) for p in some])
            out.append((hashes[used[2:]], spelled[used[2:]], number[tokens], *[np.array([p[k] for p in some], np.int64) for k in (2, 3)], sizes, *[np.array([p[k] for p in some], np.int64) for k in (1, 4)]))
            n = m
        return out

    return df.select(F.col(key).cast("long").alias("doc"), train.alias("train"), F.col(text).alias("text")).mapInArrow(apply, _CHUNK)


def exchange(found: DataFrame, tag: str, least: float | None = None) -> DataFrame:
    """chunk, bucket, back: for each hash that a chunk has sent to a bucket, in the order sent, the
    sum of all chunks' values, or if it is least at least. found: bucket, chunk, keys (sorted) and vals."""

    def meet(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(k).view(np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        vals = [unpacked(v) for v in table.column("vals").to_pylist()]
        order, every = ordered(np.concatenate(keys))
        fresh = np.append(True, every[1:] != every[:-1])
        total = np.add.reduceat(np.concatenate(vals)[order], np.flatnonzero(fresh))
        if least is not None:
            total = (total >= least).astype(np.int64)
        out = np.empty(len(order), np.int64)
        out[order] = total[np.cumsum(fresh) - 1]
        edges = np.cumsum([0, *map(len, keys)])
        back = [packed(out[a:b]) for a, b in zip(edges, edges[1:])]
        trim()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "tag": pa.array([tag] * len(back)), "back": pa.array(back, pa.binary())})

    return materialize(found.sparkSession, found.groupBy("bucket").applyInArrow(meet, _BACK), f"lm-{tag}")


_SENT, _BACK = "bucket long, chunk long, keys binary, vals binary", "chunk long, bucket long, tag string, back binary"


def sent(number: int, keys: np.ndarray, values: np.ndarray, bits: int) -> pa.Table:
    """One row for each bucket with a key of the chunk."""
    order, keys = ordered(keys)
    values = values[order]
    bucket = keys >> U64(64 - bits)
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    some = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    steps = [np.append(keys[a : a + 1], np.diff(keys[a:b])).view(np.int64) for a, b in some]
    return pa.table(
        {"bucket": pa.array(bucket[edges[:-1]].astype(np.int64)), "chunk": pa.array([number] * len(some), pa.int64()), "keys": pa.array(map(packed, steps), pa.binary()), "vals": pa.array([packed(values[a:b]) for a, b in some], pa.binary())}
    )


def received(keys: np.ndarray, backs: list[tuple[int, bytes]]) -> np.ndarray:
    """What came back, in the order of the chunk's keys."""
    out = np.empty(len(keys), np.int64)
    if len(keys):
        out[ordered(keys)[0]] = np.concatenate([unpacked(b) for _, b in sorted(backs)])
    return out


def restored(left: pa.Table, right: pa.Table | None, depth: int, model: Lookup) -> tuple[int, Chunk, list[np.ndarray] | None]:
    """A chunk with the sequences and counts that are known so far, and which contexts are retained."""
    row = left.slice(0, 1).to_pylist()[0]
    fields = {f: unpacked(row[f]) for f in _FIELDS}
    known, others = np.cumsum(fields.pop("known")), np.cumsum(fields.pop("others").view(np.uint64), dtype=np.uint64)
    fields["word"] = np.concatenate([_MARKS, model.hashes[known], others])
    fields["spelled"] = np.concatenate([[0.0, model.tree.end_logp], model.score[known], fields["spelled"] / SPELL_UNIT])
    chunk = Chunk(fields)
    backs: dict[str, list] = {}
    for r in right.to_pylist() if right is not None else []:
        backs.setdefault(r["tag"], []).append((r["bucket"], r["back"]))
    chunk.grow()
    chunk.grow()
    if "words" in backs:
        both = received(np.concatenate(chunk.keys), backs["words"])
        chunk.counts = [both[: len(chunk.keys[0])], both[len(chunk.keys[0]) :]]
    for k in range(2, depth + 1):
        if len(chunk.counts) == k:
            chunk.grow()
            if f"length{k}" in backs:
                chunk.counts.append(received(chunk.keys[k], backs[f"length{k}"]))
            elif not len(chunk.keys[k]):
                chunk.counts.append(np.zeros(0, np.int64))
    if "retained" not in backs:
        return row["chunk"], chunk, None
    keys, own = candidates(chunk)
    every, kept, low = received(keys, backs["retained"]), [], 0
    for o in own:
        full = np.zeros(len(o), bool)
        full[o] = every[low : low + o.sum()] > 0
        low += int(o.sum())
        kept.append(full)
    return row["chunk"], chunk, kept


def candidates(chunk: Chunk) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the chunk's contexts that can be retained, and by depth which they are."""
    own = [chunk.counts[d] >= MIN_COUNT for d in range(len(chunk.keys) - 1)]
    return np.concatenate([k[o] for k, o in zip(chunk.keys, own)]), own


def score_documents(
    df: DataFrame, learn, key: str = "doc_id", text: str = "text", depth: int = DEPTH, p_min: float = P_MIN, head: int = HEAD, places: int = PLACES
) -> DataFrame:
    """Per row of df: key as doc_id, n_tokens, n_known, train_tokens, base_score (unigram) and
    score (tree), learnt from the rows where learn holds."""
    spark = df.sparkSession
    train = df.where(learn)
    counts = materialize(spark, word_counts(train, text), "lm-counts")
    texts = train.count()
    n, v, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount, distinct = min(0.9, max(0.1, (once + 1) / (once + 2 * twice + 2))), max(1, int(v))
    n, v = int(n) + texts, int(v) + (texts > 0)
    tree = fit(counts, min(texts, 1), p_min=p_min)
    top = frequent(counts, head).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    lookup = Lookup(top.column("word").to_pylist(), tree, n, discount, distinct)
    del top
    discard(counts)
    shared = spark.sparkContext.broadcast(lookup)
    found = materialize(spark, chunked(df, key, text, learn, shared, depth, places), "lm-chunks")
    bits = max(1, int(np.ceil(np.log2(max(2, 2 * n / BUCKET)))))

    def first(batches):
        for b in batches:
            for r in range(b.num_rows):
                number, chunk, _ = restored(pa.table(b.slice(r, 1)), None, depth, shared.value)
                yield from sent(number, np.concatenate(chunk.keys[:2]), np.concatenate([chunk.occurrences(0), chunk.occurrences(1)]), bits).to_batches()
                trim()

    def longer(k: int):
        def apply(left: pa.Table, right: pa.Table) -> pa.Table:
            number, chunk, _ = restored(left, right, depth, shared.value)
            trim()
            return sent(number, chunk.keys[k], chunk.occurrences(k), bits)

        return apply

    def gains(left: pa.Table, right: pa.Table) -> pa.Table:
        number, chunk, _ = restored(left, right, depth, shared.value)
        keys, own = candidates(chunk)
        out = sent(number, keys, np.concatenate([g[o] for g, o in zip(chunk.gains(shared.value), own)]), bits)
        trim()
        return out

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        _, chunk, kept = restored(left, right, depth, shared.value)
        own, m = chunk.own, len(chunk.size)
        piece = np.repeat(np.arange(m), chunk.size)[own]
        counted = chunk.counts[0][chunk.token]
        score = chunk.scores(shared.value, kept or [])
        sums = [np.bincount(piece, weights=x[own], minlength=m) for x in (np.ones(len(own)), counted > 0, np.log10(counted + 0.1), score)]
        trim()
        return pa.table(
            {"row": chunk.row, "doc_id": pa.array(chunk.doc, mask=(chunk.train & 2) > 0), "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base": sums[2], "score": sums[3]}
        )

    def together(back: DataFrame, f, schema: str) -> DataFrame:
        return found.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(f, schema)

    back = exchange(found.mapInArrow(first, _SENT), "words")
    for k in range(2, depth + 1):
        back = back.union(exchange(together(back, longer(k), _SENT), f"length{k}"))
    back = back.union(exchange(together(back, gains, _SENT), "retained", GAIN * UNIT))
    release(spark)
    pieces = together(back, scores, "row long, doc_id long, n_tokens long, n_known long, base double, score double")
    norm = float(np.log10(n + 0.1 * (v + 1)))
    return (
        pieces.groupBy("row", "doc_id")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
        .select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
    )


def report(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Learns from the rows that are not held out, scores all."""
    scored = score_documents(df, ~held_out(key), key, text, **options)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
