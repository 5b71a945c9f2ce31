"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel counts common subsequences of three bytes that span at most five, weighted by
DECAY ** span, normalised and raised to the power SHARPEN, so that gapped words and words with
inserted characters stay close to the plain word. Landmarks are picked by pivoted Cholesky
from words of labelled sentences; the Nystroem map onto them turns the kernel machine into a
linear one.

It is trained on labelled sentences as bags of words (multi-instance learning): a sentence's
margin is that of its strongest word. The witnesses of toxic sentences are words found there
far more often than elsewhere, every word of the other sentences is a negative; both count as
often as distinct sentences hold them, and only the negatives nearest to a witness are kept. A
text's two strongest words make its score, mapped to 0..1 by a logistic function fit on the
labelled rows.

So that the margin reaches them, witnesses also count with one character put in between, drawn
from all characters of the training words. Marks inside a word are dropped ("i.d.i.o.t"), runs of
single characters are also read as one word ("i d i o t"). Bounds of the fit, all parameters or
constants below: TOXIC + CLEAN labelled rows; WITNESSES + NEGATIVES words of 3 to 64 bytes, of
these the HARDEST nearest; LANDMARKS, from the witnesses and NEAR words like
them. They are chosen by the hash of the row's key, by counts or by the kernel; every text is
scored whole, by words of any length.

Defined results: null and empty texts score as a text without any word of interest; without
labelled rows of both classes, or without witnesses, every score is 0; rows with a null key or
label are not learnt from, of several labels of a key the highest counts; repeated rows are each
scored; an empty table gives an empty one; equal counts are ordered by the word; other columns
pass unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ALNUM, SPACED, chunks, materialize, smallest, span_hashes, text_buffer, word_spans

DECAY, SHARPEN, LANDMARKS = 0.7, 2, 192
TOXIC, CLEAN, WITNESSES, NEGATIVES, HARDEST, NEAR = 2000, 4000, 600, 40_000, 6000, 400
#: Share of a word's squared weight below which it is taken to be unlike every landmark.
FLOOR = 0.25
#: Distinct words whose margins a worker remembers.
MEMO = 500_000
#: Words of a training sentence; longer ones are cut into several.
LONG = 64
_SPANS = [(a, b) for b in range(2, 5) for a in range(1, b)]
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Units:
    """Words of a chunk of texts, without marks inside, in lower case."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        keep = ALNUM[data] | ~SPACED[data]
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        self.data = _LOWER[data[keep]]
        own = at[offsets]
        self.starts, self.ends, self.first = word_spans(self.data, own, ALNUM)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        stops = np.zeros(len(data), np.int64)
        np.cumsum(_STOP[data], out=stops)
        self.sentence = stops[keep][self.starts]
        self._join_singles()

    def _join_singles(self) -> None:
        """Adds each run of three or more single characters of a sentence as one word."""
        # a character beyond ASCII counts as one; its further bytes are continuations
        extra = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=extra[1:])
        single = (extra[self.ends] - extra[self.starts]) == 1
        self.base = len(self.starts)
        if not single.any():
            return
        follow = np.zeros(len(single), bool)
        follow[1:] = single[1:] & single[:-1] & (self.row[1:] == self.row[:-1])
        heads = np.flatnonzero(single & ~follow)
        tails = np.flatnonzero(single & ~np.append(follow[1:], False))
        long = tails - heads >= 2
        more, starts, ends, rows, sents, n = [], [], [], [], [], len(self.data)
        for h, t in zip(heads[long].tolist(), tails[long].tolist()):
            joined = np.concatenate([self.data[self.starts[k] : self.ends[k]] for k in range(h, t + 1)])
            more.append(joined), starts.append(n), rows.append(self.row[h]), sents.append(self.sentence[h])
            n += len(joined)
            ends.append(n)
        if more:
            self.data = np.concatenate([self.data, *more])
            self.starts, self.ends = np.append(self.starts, starts), np.append(self.ends, ends)
            self.row, self.sentence = np.append(self.row, rows), np.append(self.sentence, sents)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words, a place of each, and for every word its number."""
        return np.unique(span_hashes(self.data, self.starts, self.ends), return_index=True, return_inverse=True)


def subsequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code of three bytes, weight) for each occurrence in each word."""
    words, codes, weights = [], [], []
    size = ends - starts
    total = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(starts)), size)
    place = np.arange(total[-1]) - total[:-1][word] + starts[word]
    left = ends[word] - place
    wide = data.astype(np.int32)
    for a, b in _SPANS:
        own = left > b
        p = place[own]
        words.append(word[own])
        codes.append((wide[p] << 16) | (wide[p + a] << 8) | wide[p + b])
        weights.append(np.full(len(p), DECAY ** (b + 1)))
    return np.concatenate(words), np.concatenate(codes), np.concatenate(weights)


def pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return np.frombuffer(b"".join(words), np.uint8), ends - np.array([len(w) for w in words], dtype=np.int64), ends


class Kernel:
    """Normalised kernel of any words against fixed ones."""

    def __init__(self, words: list[bytes]):
        self.words = words
        word, code, weight = subsequences(*pack(words)) if words else (np.zeros(0, int),) * 3
        self.codes = np.unique(code)
        table = np.zeros((len(self.codes), len(words)))
        np.add.at(table, (np.searchsorted(self.codes, code), word), weight)
        norm = np.sqrt((table**2).sum(0))
        table /= np.where(norm > 0, norm, 1)
        # most cells are empty: by code, the landmarks that have it and their weights
        at, self.landmark = np.nonzero(table)
        self.entry = table[at, self.landmark]
        self.first = np.searchsorted(at, np.arange(len(self.codes) + 1))
        self.known = np.zeros(1 << 24, bool)
        self.known[self.codes] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known = np.zeros(1 << 24, bool)
        self.known[self.codes] = True

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with more than FLOOR of their weight in subsequences of the fixed words, and their
        kernel values ** SHARPEN. All other words count as 0."""
        word, code, weight = subsequences(data, starts, ends)
        in_table = self.known[code]
        square = weight * weight
        shared = np.bincount(word[in_table], weights=square[in_table], minlength=len(starts))
        hit = shared > FLOOR * np.bincount(word, weights=square, minlength=len(starts))
        own = hit[word]
        key, back = np.unique((word[own].astype(np.int64) << 24) | code[own], return_inverse=True)
        value = np.bincount(back, weights=weight[own], minlength=len(key))
        who, what = key >> 24, key & 0xFFFFFF
        norm = np.sqrt(np.bincount(who, weights=value**2, minlength=len(starts)))
        some = np.flatnonzero(hit)
        out = np.zeros((len(some), len(self.words)))
        in_table = self.known[what]
        who, f = who[in_table], np.searchsorted(self.codes, what[in_table])
        v = value[in_table] / norm[who]
        edges = np.searchsorted(who, np.append(some, len(starts)))  # who is sorted
        m = len(self.words)
        for i in range(0, len(some), 4096):  # bounded temporaries
            j = min(i + 4096, len(some))
            a, b = edges[i], edges[j]
            times = self.first[f[a:b] + 1] - self.first[f[a:b]]
            ends_at = np.cumsum(times)
            entry = np.arange(ends_at[-1]) + np.repeat(self.first[f[a:b]] - (ends_at - times), times)
            cell = np.repeat(np.searchsorted(some, who[a:b]) - i, times) * m + self.landmark[entry]
            out[i:j] = np.bincount(cell, weights=np.repeat(v[a:b], times) * self.entry[entry], minlength=(j - i) * m).reshape(j - i, m)
        np.minimum(out, 1.0, out=out)
        return some, out**SHARPEN


def pick_landmarks(words: list[bytes], m: int) -> list[int]:
    """Pivoted Cholesky: each next word is the one worst represented so far."""
    some, k = Kernel(words).rows(*pack(words))
    gram = np.zeros((len(words), len(words)))
    gram[some] = k
    left, factor, chosen = np.diag(gram).copy(), np.zeros((len(words), 0)), []
    for _ in range(min(m, len(words))):
        p = int(np.argmax(left))
        if left[p] < 1e-3:
            break
        column = (gram[:, p] - factor @ factor[p]) / np.sqrt(left[p])
        factor = np.column_stack([factor, column])
        left -= column**2
        chosen.append(p)
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        own = slack > 0
        gradient = ridge * w - 2 * x[own].T @ (cost[own] * y[own] * slack[own])
        step = np.linalg.solve(np.diag(ridge) + 2 * (x[own].T * cost[own]) @ x[own], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float):
        self.kernel, self.weights, self.bias = Kernel(landmarks), weights, bias
        self.logit = np.array([1.0, 1.0, 0.0])
        self.memo = np.zeros(0, np.uint64), np.zeros(0)

    def _words(self, units: Units, hashes: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Margins of distinct words, given by sorted hashes and places."""
        keys, values = self.memo
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
        margin = np.full(len(one), self.bias)
        margin[known] = values[at[known]]
        rest = np.flatnonzero(~known)
        for k in range(0, len(rest), 4_000):
            part = rest[k : k + 4_000]
            some, x = self.kernel.rows(units.data, units.starts[one[part]], units.ends[one[part]])
            margin[part[some]] += x @ self.weights
        if len(keys) + len(rest) > MEMO:
            keys, values = keys[:0], values[:0]
        if len(rest):
            keys, values = np.append(keys, hashes[rest]), np.append(values, margin[rest])
            order = np.argsort(keys, kind="stable")
            self.memo = keys[order], values[order]
        return margin

    def margins(self, column: pa.Array) -> np.ndarray:
        """The two highest word margins of each text; -2 stands for no word."""
        data, offsets = text_buffer(column)
        out = np.full((len(offsets) - 1, 2), -2.0)
        for i, j in chunks(offsets):
            low = int(offsets[i])
            units = Units(data[low : int(offsets[j])], offsets[i : j + 1] - low)
            if not len(units.starts):
                continue
            hashes, one, back = units.distinct()
            value = self._words(units, hashes, one)[back]
            order = np.lexsort((value, units.row))
            row, value = units.row[order], value[order]
            last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
            out[i + row[last], 0] = value[last]
            more = last[(last > 0) & (row[last - 1] == row[last])]
            out[i + row[more], 1] = value[more - 1]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        z = self.margins(column) @ self.logit[:2] + self.logit[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Never:
    """What is learnt from rows of one class only."""

    def score(self, column: pa.Array) -> np.ndarray:
        return np.zeros(len(column))


def sentences(df: DataFrame) -> DataFrame:
    """doc, toxic, words array<binary> of each sentence; long ones in pieces."""

    def apply(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(2))
            keys, toxic = b.column(0), b.column(1).to_pylist()
            for i, j in chunks(offsets):
                low = int(offsets[i])
                u = Units(data[low : int(offsets[j])], offsets[i : j + 1] - low)
                raw = u.data.tobytes()
                order = np.lexsort((np.arange(len(u.row)), u.sentence, u.row))
                rows, parts = [], []
                last = None
                for k in order.tolist():
                    at = (u.row[k], u.sentence[k])
                    if at != last or len(parts[-1]) >= LONG:
                        rows.append(int(u.row[k])), parts.append([])
                        last = at
                    parts[-1].append(raw[u.starts[k] : u.ends[k]])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([i + r for r in rows], pa.int64())), pa.array([toxic[i + r] for r in rows], pa.int32()), pa.array(parts, pa.list_(pa.binary()))], names=["doc", "toxic", "words"])

    return df.mapInArrow(apply, "doc long, toxic int, words array<binary>")


def learns(key: str):
    """Rows whose labels may be learnt."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", landmarks: int = LANDMARKS):
    """A model from labelled rows; labels: doc_id, toxic."""
    spark = docs.sparkSession
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learns("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = None
    for wanted, most in ((1, TOXIC), (0, CLEAN)):
        part = smallest(own.where((F.col("toxic") > 0) == F.lit(bool(wanted))), F.xxhash64("doc_id"), most, "doc_id")
        chosen = part if chosen is None else chosen.union(part)
    # at most TOXIC + CLEAN ids
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(spark, picked.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), "text"), "toxic-sample")
    cut = materialize(spark, sentences(sample), "toxic-sentences")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Never()
    held = cut.groupBy("words").agg(F.max("toxic").alias("toxic")).select("toxic", F.explode(F.array_distinct("words")).alias("w"))
    by_word = held.where(F.octet_length("w").between(3, 64)).groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    by_word = materialize(spark, by_word, "toxic-words")
    share = float(n[1]) / float(n[0])
    odds = F.log((F.col("a") + 0.1) / (F.col("b") + 0.1) / F.lit(share))
    least = max(2, min(5, n[1] // 20))
    tells = (F.col("a") >= least) & (odds > 2.5)
    telling = by_word.where(tells).orderBy(F.desc(odds * F.sqrt("a")), "w").limit(WITNESSES).collect()
    other = by_word.where(~tells & (F.col("b") >= 1)).orderBy(F.desc("b"), "w").limit(NEGATIVES).collect()
    if not telling or not other:
        return Never()
    model = learn([(bytes(r.w), r.a, r.b) for r in telling], [(bytes(r.w), r.b) for r in other], landmarks)
    found = margins(sample, model).select("first", "second", "toxic").collect()
    model.logit = logistic(np.array([[r.first, r.second] for r in found]), np.array([r.toxic for r in found], dtype=float))
    return model


def disguised(word: bytes, letters: bytes) -> list[bytes]:
    """A word with one character put in between, for words long enough to be known by the rest."""
    if len(word) < 5 or max(word) > 127 or not letters:
        return []
    seed = sum(word)
    return [word[:i] + bytes([letters[(seed + 7 * i) % len(letters)]]) + word[i:] for i in range(1, len(word))]


class Space:
    """The Nystroem map onto landmarks."""

    def __init__(self, marks: list[bytes]):
        self.marks, self.kernel = marks, Kernel(marks)
        values, vectors = np.linalg.eigh((g := self.raw(marks)) / 2 + g.T / 2)
        self.half = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def raw(self, words: list[bytes]) -> np.ndarray:
        x = np.zeros((len(words), len(self.marks)))
        some, k = self.kernel.rows(*pack(words))
        x[some] = k
        return x

    def machine(self, rows: list[tuple[bytes, float, float]]) -> Model:
        """Of (word, class, weight)."""
        w = train_svm(self.raw([w for w, _, _ in rows]) @ self.half, np.array([y for _, y, _ in rows]), np.minimum([c for _, _, c in rows], 50).astype(float))
        return Model(self.marks, self.half @ w[:-1], float(w[-1]))


def learn(telling: list[tuple[bytes, int, int]], other: list[tuple[bytes, int]], landmarks: int = LANDMARKS, hardest: int = HARDEST) -> Model:
    """The machine from witnesses (word, toxic and other sentences) and other words (word, sentences).
    Of the other words those nearest to the witnesses are kept: far ones have no part in the margin."""
    witnesses = [w for w, _, _ in telling]
    kernel, near = Kernel(witnesses), np.zeros(len(other))
    for i in range(0, len(other), 2000):
        some, k = kernel.rows(*pack([w for w, _ in other[i : i + 2000]]))
        if len(some):
            near[i + some] = k.max(1)
    order = np.argsort(-near, kind="stable")
    hard = [other[i] for i in order[:hardest]]
    letters = bytes(sorted({c for w, _ in other for c in w if c < 128}))
    # two thirds of the landmarks from witnesses, the others from the words most like them
    marks = [witnesses[i] for i in pick_landmarks(witnesses, landmarks * 2 // 3)]
    rest = [w for w, b in hard if b > 1][:NEAR]
    marks += [rest[i] for i in pick_landmarks(rest, landmarks - len(marks))] if rest else []
    space = Space(marks)
    rows = [(w, 1.0, a) for w, a, _ in telling] + [(v, 1.0, a / 20) for w, a, b in telling if 10 * b < a for v in disguised(w, letters)] + [(w, -1.0, b) for w, b in hard] + [(w, -1.0, b) for w, _, b in telling if b]
    return space.machine(rows)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + 1e-4 * w
        h = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x / len(y) + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    return w


def margins(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with the text's two highest word margins, first and second."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            m = shared.value.margins(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m[:, 0].copy()), pa.array(m[:, 1].copy())], names=[*b.schema.names, "first", "second"])

    return df.mapInArrow(apply, T.StructType([*df.schema.fields, T.StructField("first", T.DoubleType()), T.StructField("second", T.DoubleType())]))


def annotate(df: DataFrame, model, out: str = "toxicity", text: str = "text") -> DataFrame:
    """df with a score column; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in keep]

    def apply(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(shared.value.score(b.column(text)))], names=[*names, out])

    return df.mapInArrow(apply, T.StructType([*keep, T.StructField(out, T.DoubleType())]))


def report(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    model = fit(df, labels, key, text)
    found = annotate(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), model, "score")
    return found.select("doc_id", (~learns("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove(df: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    model = fit(df, labels)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), "text")
    return annotate(packed, model).where(F.col("toxicity") < threshold).select(*[F.col(f"row.`{c}`") for c in df.columns])
