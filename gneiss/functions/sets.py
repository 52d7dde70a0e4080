"""Sets as sorted arrays: similarities, distances, fingerprints of on-bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of distinct arrays; 0 where both are empty (as a distance: 1)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def sign_bits(vector: Column) -> Column:
    """Places of a vector's positive entries: a fingerprint."""
    return F.filter(F.transform(vector, lambda x, i: F.when(x > 0, i).otherwise(-1)), lambda i: i >= 0)


def words_of_bits(bits: Column, n: int) -> Column:
    """On-bits as 64-bit words, for ``bit_count`` similarity."""
    word = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))))
    return F.array(*[word(w) for w in range(-(-n // 64))])


def tanimoto_words(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    both = total(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)))).cast("double")
    either = total(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
