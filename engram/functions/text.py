"""Text functions: tokens, terms, edit distance, units, intent, polarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which words count.
STOP_WORDS = (
    "the a an of to and or in on at is was were are am be been being for with by from "
    "that this these those it its as if then than so such have has had do does did will "
    "would shall should can could may might must not no but into over under about"
).split()
PROTECTED_WORDS = (
    "last next first this that these those from over under about after before during "
    "there where when what which while since until between against through many much "
    "more most some other another every each both few less least same than then only "
    "just also very such even still back down left right near far high low long short "
    "time hour day week month year today yesterday tomorrow night morning shift line "
    "show find list give tell make take come know think want need said says"
).split()
# Units, phrases of time, words that tell an intent, an answer's place, a negation or an opposite.
UNIT = r"(?i)\b(\d+(?:\.\d+)?)\s*(mm/s|mm|bar|nm|rpm|°?c|hz|kw|a|v|ms|s|min|h)\b"
# a lead-in such as "in the" changes no match and is left out
RELATIVE_TIME = r"(?i)\b(?:last|past|previous)\s+(\d+)?\s*(second|minute|hour|day|week|month)s?\b"
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000}
INTENT_WORDS = {
    "sensor": ("sensor", "reading", "telemetry", "measurement", "vibration", "temperature"),
    "procedural": ("procedure", "steps", "how", "recovery", "fix", "repair", "checklist"),
    "episodic": ("happened", "yesterday", "shift", "event", "when", "log"),
    "semantic": ("rule", "policy", "threshold", "limit", "definition", "means"),
}
#: Where an answer looks, by the words of its question: pattern and number of hits; else everywhere, 5.
ANSWER_PLANS = {
    "procedural": (r"(?i)\b(how do i|how to|steps|procedure|recovery|fix|repair|restore)\b", 4),
    "sensor": (r"(?i)\b(how many|count|average|total|rate|trend)\b", 8),
    "episodic": (r"(?i)\b(when|last|latest|recent|yesterday|today|history|since)\b", 6),
}
NEGATIONS = r"(?i)\b(not|no longer|never|without|lifted|revoked|cancelled|canceled|reversed|disabled|removed|superseded|obsolete|deprecated|rescinded)\b"
ANTONYMS = [("above", "below"), ("increase", "decrease"), ("open", "closed"), ("enable", "disable"), ("start", "stop"), ("raise", "lower"), ("allow", "deny"), ("on", "off"), ("up", "down")]


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column, longer_than: int = 1) -> Column:
    """Tokens that are no stop words and longer than some characters."""
    return F.filter(tokenize(text), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > longer_than))


def terms(text: Column) -> Column:
    """Content tokens, then the pairs of adjacent ones as a_b."""
    kept = content_tokens(text)
    pairs = F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(kept, pairs)


def canonical(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def bounded_levenshtein(a: Column, b: Column, cap: int) -> Column:
    """Edit distance, cap + 1 beyond cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def lexical_overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token arrays taken as sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def polarity(text: Column) -> Column:
    """Whether a text negates, then whether it has each word of ANTONYMS."""
    low = F.lower(text)
    return F.array(text.rlike(NEGATIONS), *[low.rlike(rf"\b{w}\b") for pair in ANTONYMS for w in pair])


def opposed(a: Column, b: Column) -> Column:
    """polarity_signals() of two texts' polarity()."""
    across = [F.when((F.get(a, F.lit(1 + 2 * i)) & F.get(b, F.lit(2 + 2 * i))) | (F.get(a, F.lit(2 + 2 * i)) & F.get(b, F.lit(1 + 2 * i))), F.lit(f"antonym:{x}/{y}")) for i, (x, y) in enumerate(ANTONYMS)]
    return F.array_compact(F.array(F.when(F.get(a, F.lit(0)) != F.get(b, F.lit(0)), F.lit("negation_flip")), *across))


def polarity_signals(a: Column, b: Column) -> Column:
    """negation_flip, and antonym:x/y for each pair that stands across the two texts."""
    return opposed(polarity(a), polarity(b))


def intent(tokens: Column) -> Column:
    """The class with the most of its words among the tokens; the first wins ties, null if none."""
    def count(values: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(list(values))))

    hits = {k: count(v) for k, v in INTENT_WORDS.items()}
    top = reduce(F.greatest, hits.values())
    out = F.lit(None).cast("string")
    for k in reversed(INTENT_WORDS):
        out = F.when(hits[k] == top, F.lit(k)).otherwise(out)
    return F.when(top > 0, out)


def answer_plan(question: Column) -> Column:
    """struct(collection, k) of the first plan whose words the question has."""
    out = F.struct(F.lit("*").alias("collection"), F.lit(5).alias("k"))
    for name, (pattern, k) in reversed(ANSWER_PLANS.items()):
        out = F.when(question.rlike(pattern), F.struct(F.lit(name).alias("collection"), F.lit(k).alias("k"))).otherwise(out)
    return out


def normalise_units(text: Column) -> Column:
    return F.regexp_replace(text, UNIT, "$1 $2")


def units(text: Column) -> Column:
    """array<struct<value double, unit string>> of the measurements in the text."""
    values, names = (F.regexp_extract_all(text, F.lit(UNIT), F.lit(k)) for k in (1, 2))
    return F.zip_with(values, names, lambda v, u: F.struct(v.cast("double").alias("value"), F.regexp_replace(F.lower(u), "°", "").alias("unit")))


def relative_seconds(text: Column) -> Column:
    """How far back "last N units" reaches, in seconds; null without such a phrase."""
    n = F.regexp_extract(text, RELATIVE_TIME, 1)
    unit = F.lower(F.regexp_extract(text, RELATIVE_TIME, 2))
    size = F.lit(None).cast("int")
    for k, v in SECONDS.items():
        size = F.when(unit == k, v).otherwise(size)
    return F.when(n == "", 1).otherwise(n.cast("int")) * size
