"""Quality rules: statistics of simple rules, and an isolation forest over them.

Each text gets rule statistics (counts that word, line, symbol and repetition rules use) and
from them by how much it breaks each rule. Where a rule begins to count is calibrated from
labelled rows: all but GOOD of the good ones keep it. Random trees split random statistics at
random values; a text that few splits isolate is anomalous. The threshold on the path-length
score is calibrated from labelled rows as well.

The forest is fit on at most SAMPLE labelled rows, those with the smallest hash of their key: an
isolation forest needs no more than trees x 256 rows. Statistics and scores cover every row, the
calibration every labelled one. Only labelled rows are scored for it.

Defined results: null and empty texts have only zeros and fail the base rules; without labelled
rows there is no forest, every anomaly is 0.5 and the threshold DEFAULT_THRESHOLD; of a key with
several labels each counts, and only such a key's rows count as often; repeated rows are each
reported; texts of any length are read whole; an empty table gives an empty one; of thresholds
that are equally good the highest is taken; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPACED, U64, chunks, discard, gram_hashes, materialize, mix, smallest, span_hashes, text_buffer, word_spans

SAMPLE, TREES, PSI, DEPTH, SEED = 16_384, 128, 256, 12, 7
DEFAULT_THRESHOLD = 0.72
#: Share of good labelled rows that the threshold may reject.
MAX_LOSS = 0.005
#: Steps of the score in the calibration.
STEPS = 2000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_punct"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_PUNCT &= ~_SYMBOL


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of flags[edges[i]:edges[i+1]]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(row.astype(np.uint64) + U64(1)))


def count_statistics(column: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text."""
    data, offsets = text_buffer(column)
    out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
    for i, j in chunks(offsets):
        low = int(offsets[i])
        part, own = data[low : int(offsets[j])], offsets[i : j + 1] - low
        starts, ends, first = word_spans(part, own, SPACED)
        n = np.diff(first)
        row = np.repeat(np.arange(j - i), n)
        chars = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
        got = {"n_words": n, "word_chars": _sums(chars[ends] - chars[starts], first)}
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_punct", _PUNCT)):
            got[name] = _sums(table[part], own)
        # lines with a word: the newlines before each word tell its line
        newlines = np.flatnonzero(part == 10)
        before = np.searchsorted(newlines, starts)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (before[1:] != before[:-1]) | (row[1:] != row[:-1])
        line_row, before = row[fresh], before[fresh]
        edge = np.concatenate([[-1], newlines, [len(part)]])
        opening = np.maximum(edge[before] + 1, own[line_row])
        closing = np.minimum(edge[before + 1], own[line_row + 1])
        line_key = _keyed(span_hashes(part, opening, closing, fold=False), line_row)
        total = np.bincount(line_row, minlength=j - i)
        _, at = np.unique(line_key, return_index=True)
        got["n_lines"] = total
        got["n_dup_lines"] = total - np.bincount(line_row[at], minlength=j - i)
        words = span_hashes(part, starts, ends, fold=False)
        repeated = np.zeros(len(words), bool)
        grams = gram_hashes(words, 3)
        inner = np.flatnonzero(row[: len(grams)] == row[2:]) if len(grams) else np.zeros(0, np.int64)
        if len(inner):
            _, back, times = np.unique(_keyed(grams[inner], row[inner]), return_inverse=True, return_counts=True)
            twice = inner[times[back] > 1]
            for d in range(3):
                repeated[twice + d] = True
        got["n_repeat_words"] = _sums(repeated, first)
        for k, name in enumerate(COUNTS):
            out[i:j, k] = got[name]
    return out


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key as doc_id, and COUNTS of the text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def apply(batches):
        for b in batches:
            x = count_statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(x[:, k]) for k in range(len(COUNTS))]], names=["doc_id", *COUNTS])

    return df.select(key, text).mapInArrow(apply, schema)


#: Where each rule's statistic begins to count; below, a text breaks no rule and all such texts look alike.
MEAN_WORD, SYMBOLS, DUP_LINES, REPEATS, UPPER, PUNCT, LETTERS = (3, 10), 0.1, 0.3, 0.2, 0.3, 0.5, 0.7


RULES = [f"rule_{k}" for k in range(7)]
#: Share of good labelled rows that a rule must leave alone.
GOOD = 0.999


def broken() -> list[Column]:
    """By how much each rule is broken. Shares and means only: a long text is no anomaly by its length."""

    def share(part: Column | str, of: str, most: float | None = None) -> Column:
        x = (F.col(part) if isinstance(part, str) else part) / F.greatest(F.col(of), F.lit(1))
        return x if most is None else F.least(x, F.lit(most))

    mean = share("word_chars", "n_words", 20.0)
    over = [
        F.greatest(MEAN_WORD[0] - mean, mean - MEAN_WORD[1]),
        share("n_symbols", "n_words", 3.0) - SYMBOLS,
        share("n_dup_lines", "n_lines") - DUP_LINES,
        share("n_repeat_words", "n_words") - REPEATS,
        share("n_upper", "n_letters") - UPPER,
        share("n_punct", "n_words", 3.0) - PUNCT,
        LETTERS - share("n_letters", "word_chars"),
    ]
    return [F.greatest(x, F.lit(0.0)).alias(r) for x, r in zip(over, RULES)]


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))


def limits(labelled: DataFrame) -> list[float]:
    """What good labelled rows may break of each rule."""
    r = labelled.where(~base_failed() & (F.col("quality") > 0)).agg(*[F.percentile_approx(c, F.lit(GOOD), F.lit(10_000)).alias(c) for c in RULES]).first()
    return [float(r[c] or 0.0) for c in RULES]


def excess(c: dict[str, np.ndarray], limit: list[float]) -> np.ndarray:
    return np.maximum(np.stack([c[k] for k in RULES], axis=1) - np.array(limit), 0)


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.norm = path_norm(min(psi, len(rows))) or 1.0
        self.trees = [self._grow(rows[rng.choice(len(rows), min(psi, len(rows)), replace=False)], depth, rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def _grow(rows: np.ndarray, depth: int, rng) -> tuple[np.ndarray, ...]:
        feature, value, left, length = [], [], [], []

        def node(x: np.ndarray, at: int, me: int) -> None:
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
            if at >= depth or not len(spread):
                length[me] = at + path_norm(len(x))
                return
            f = int(rng.choice(spread))
            v = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            feature[me], value[me], left[me] = f, v, len(feature)
            for _ in range(2):
                feature.append(-1), value.append(0.0), left.append(0), length.append(0.0)
            mine = left[me]
            node(x[x[:, f] < v], at + 1, mine)
            node(x[x[:, f] >= v], at + 1, mine + 1)

        feature.append(-1), value.append(0.0), left.append(0), length.append(0.0)
        node(rows, 0, 0)
        return np.array(feature), np.array(value), np.array(left), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / norm): near 1 for anomalies."""
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, value, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[every, np.maximum(f, 0)] >= value[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def base_failed():
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_forest(labelled: DataFrame, limit: list[float], sample: int = SAMPLE) -> IsolationForest:
    """From statistics of labelled rows."""
    rows = smallest(labelled.where(~base_failed()), F.xxhash64("doc_id"), sample, *RULES).select(*RULES).collect()
    return IsolationForest(excess({k: np.array([r[k] for r in rows], dtype=float) for k in RULES}, limit))


def score(stats: DataFrame, forest: IsolationForest, limit: list[float]) -> DataFrame:
    """stats with the anomaly score; rows that fail the base rules get 1."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())])

    def apply(batches):
        for b in batches:
            c = {k: b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ["n_words", "n_repeat_words", *RULES]}
            s = shared.value.score(excess(c, limit))
            s[(c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])] = 1.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "anomaly"])

    return stats.mapInArrow(apply, schema)


def calibrate(scored: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """The lowest threshold that rejects at most max_loss of the rows labelled good, among
    those that separate: where the gain over the next higher step is all in bad rows."""
    steps = scored.where(~base_failed()).groupBy(F.floor(F.col("anomaly") * STEPS).cast("int").alias("step"), (F.col("quality") > 0).alias("good")).count().collect()
    good, bad = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for r in steps:
        (good if r["good"] else bad)[r["step"]] += r["count"]
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    loss = np.cumsum(good[::-1])[::-1] / good.sum()
    caught = np.cumsum(bad[::-1])[::-1] / bad.sum()
    allowed = np.flatnonzero(loss <= max_loss)
    gain = caught[allowed] - 20 * loss[allowed]
    return float(allowed[np.flatnonzero(gain == gain.max())[-1]] / STEPS)


def assess(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: COUNTS, anomaly, base_failed and kept."""
    stats = materialize(df.sparkSession, statistics(df, key, text).select("*", *broken()), "quality-stats")
    labelled = materialize(df.sparkSession, stats.join(_good(labels).hint("merge"), "doc_id"), "quality-labelled")
    limit = limits(labelled)
    forest = fit_forest(labelled, limit)
    threshold = calibrate(score(labelled, forest, limit), **options)
    discard(labelled)
    return score(stats, forest, limit).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))
