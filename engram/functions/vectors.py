"""Vector functions on arrays: products, norms, scalar and sign quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def int8_scale(v: Column) -> Column:
    """Largest absolute value; 1 for a zero vector."""
    s = F.array_max(F.transform(doubles(v), F.abs))
    return F.when(s == 0, F.lit(1.0)).otherwise(s)


def int8_encode(v: Column, scale: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.greatest(F.least(F.rint(x / scale * 127), F.lit(127.0)), F.lit(-127.0)).cast("int"))


def int8_decode(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c / F.lit(127.0) * scale)


def sign_bits(v: Column) -> Column:
    return F.transform(v, lambda x: (x > 0).cast("int"))


def sign_similarity(a: Column, b: Column) -> Column:
    """1 - 2 * hamming / dimensions."""
    ham = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return 1 - 2 * ham / F.size(a)


def clip_norm(v: Column, most: float) -> Column:
    """The vector scaled down to a norm of most."""
    n = norm(v)
    f = F.when(n > most, most / n).otherwise(F.lit(1.0))
    return F.transform(doubles(v), lambda x: x * f)
