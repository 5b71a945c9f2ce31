"""Secret scans with SQL functions only: fixed patterns and character Markov models.

Three patterns give the base spans. Beyond them, every run of at least MIN_RUN token characters
is compared under two first-order character models: one of random strings, trained from the
strings that the patterns label as secrets, mixed with a uniform one, one of ordinary identifiers,
trained from all other words of all rows, each distinct string once. A run is added as a
"markov" span when its log-likelihood ratio is above a threshold, which is calibrated on all
rows: it is the log of COST times the number of other runs over that of labelled secrets, so a
run counts when it is COST times likelier a secret than not.

Positions come without a regex engine that tells them: the pieces between matches and the
matches themselves are laid end to end. What is gathered for the models is two tables of at most
128 x 128 counts and two numbers, whatever the corpus.

Defined results: null and empty texts have no spans, an empty table gives an empty one; repeated
rows are each reported; texts of any length are scanned whole; a run at the threshold counts;
where no string is labelled as a secret the threshold is DEFAULT_THRESHOLD, where there is no ordinary word the method adds no spans; other columns are
not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize

#: Characters of a run that is judged; weight of a character's own frequency; share of random strings over
#: all token characters; weight of a false alarm.
MIN_RUN, BACKOFF, UNIFORM, COST, DEFAULT_THRESHOLD = 12, 20, 0.2, 20.0, 12.0
TOKEN_CHARACTERS = 67
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A first look that costs little: assignments name one of these.
NAMED = r"(?i)(?:passw|secret|token|api_?key)"
# maximal runs of enough characters, which is what dropping shorter matches leaves
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
KINDS = ("assign", "access", "hex", "markov")
_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def _spans(text: Column, pattern: str, kind: int, value: Column | None = None) -> Column:
    """(start, kind, end, matched string) of each leftmost match, in code points."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"), (found if value is None else value).alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["v"].alias("v")))
        return F.struct(F.coalesce(e, s).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(F.coalesce(acc["out"], F.array().cast(_SPAN)), one)).alias("out"))

    return F.coalesce(F.aggregate(pairs, start, step, lambda a: a["out"]), F.array().cast(_SPAN))


def _where(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    assign = F.filter(_spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), lambda x: F.length(x["v"]) >= 12)
    parts = [_where(text.rlike(NAMED), assign), _where(text.rlike(ACCESS), _spans(text, ACCESS, 1)), _where(text.rlike(HEX), _spans(text, HEX, 2))]
    return F.array_sort(F.concat(*parts))


def candidate_runs(text: Column) -> Column:
    return _where(text.rlike(RUN), _spans(text, RUN, 3))


def _pairs(words: DataFrame) -> DataFrame:
    """Counts of adjacent ASCII characters over distinct words (column w)."""
    one = words.where(F.length("w") > 1).distinct()
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p")
    return one.select(pair).groupBy("p").count()


def _table(rows: list, less: int = 0) -> dict[tuple[int, int], float]:
    """Log-probabilities of the second character after the first, smoothed by its own frequency.
    less: what is taken off each count, so that a string that is judged does not speak for itself."""
    counts = {(ord(r["p"][0]), ord(r["p"][1])): r["count"] - less for r in rows if len(r["p"]) == 2 and max(map(ord, r["p"])) < 128}
    after, single = [0] * 128, [0] * 128
    for (a, b), c in counts.items():
        after[a] += c
        single[b] += c
    total = sum(single)
    base = [(c + 0.5) / (total + 64) for c in single]
    return {(a, b): math.log((counts.get((a, b), 0) + BACKOFF * base[b]) / (after[a] + BACKOFF)) for a in range(128) for b in range(128)}


def train(scanned: DataFrame, docs: DataFrame, text: str) -> list[float] | None:
    """Log-likelihood ratio of each pair of characters, at 128 * first + second."""
    random = _pairs(scanned.select(F.explode("base").alias("b")).select(F.col("b.v").alias("w"))).collect()
    clean = F.coalesce(F.col(text), F.lit(""))
    for known, labelled in ((NAMED, ASSIGN), (ACCESS, ACCESS), (HEX, HEX)):
        clean = F.when(clean.rlike(known), F.regexp_replace(clean, labelled, " ")).otherwise(clean)
    words = docs.select(F.explode(F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("w"))
    ordinary = _pairs(words).collect()
    if not ordinary:
        return None
    r, o = _table(random), _table(ordinary, 1)
    mixed = {k: math.log((1 - UNIFORM) * math.exp(x) + UNIFORM / TOKEN_CHARACTERS) for k, x in r.items()}
    return [mixed[a, b] - o[a, b] for a in range(128) for b in range(128)]


def calibrate(scored: DataFrame) -> float:
    """The threshold, from the numbers of base spans and of other runs."""
    n = scored.agg(F.sum(F.size("base")).alias("secrets"), F.sum(F.size("free")).alias("others")).first()
    return math.log(COST * max(n.others, 1) / n.secrets) if n.secrets else DEFAULT_THRESHOLD


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base (spans of the patterns) and added (spans of the models); a span has
    start s, kind number k, end e and string v."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = materialize(df.sparkSession, df.select(F.col(key), base_spans(t).alias("base"), candidate_runs(t).alias("runs")), "secrets")
    ratios = train(found, df, text)
    if ratios is None:
        return found.select(key, "base", F.array().cast(_SPAN).alias("added"))
    # one string literal, folded into an array once
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")

    def rated(x: Column) -> Column:
        v = x["v"]
        total = F.aggregate(F.sequence(F.lit(2), F.length(v)), F.lit(0.0), lambda s, i: s + F.get(table, F.ascii(F.substring(v, i - 1, F.lit(1))) * 128 + F.ascii(F.substring(v, i, F.lit(1)))))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), v.alias("v"), total.alias("ratio"))

    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    scored = materialize(df.sparkSession, found.select(key, F.transform("base", rated).alias("base"), F.transform(free, rated).alias("free")), "secrets-rated")
    discard(found)
    threshold = calibrate(scored)

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))

    return scored.select(key, plain(F.col("base")).alias("base"), plain(F.filter("free", lambda r: r["ratio"] >= threshold)).alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of base spans, their digest, and all spans as text."""

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return scan(df, key, text).select(
        F.col(key).cast("long").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
