"""Pair similarity column functions over packed signatures and float vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("hamming", "cosine", "dot_product")


def check_measure(measure: str) -> str:
    if measure not in MEASURES:
        raise ValueError(f"no similarity named {measure!r}")
    return measure


def _total(parts: Sequence[Column]) -> Column:
    acc = parts[0]
    for p in parts[1:]:
        acc = acc + p
    return acc


def hamming_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Number of differing bits; both sides must have the same word layout."""
    if len(a) != len(b):
        raise ValueError("signatures must have the same number of bits")
    return _total([F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)]).cast("int")


def hamming_similarity(a: Sequence[Column], b: Sequence[Column], f: int) -> Column:
    """Number of equal positions: f - distance."""
    return (F.lit(f) - hamming_distance(a, b)).cast("int")


def ones(a: Sequence[Column]) -> Column:
    return _total([F.bit_count(x) for x in a]).cast("int")


def common_ones(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Dot product of two 0/1 vectors."""
    return _total([F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b)]).cast("int")


def similarity_from_counts(dot: Column, ones_a: Column, ones_b: Column, f: int) -> Column:
    """Equal positions from 1-counts: dot + (f - (|a| + |b| - dot))."""
    return (dot + (F.lit(f) - (ones_a + ones_b - dot))).cast("int")


def complement_dot(a: Sequence[Column], b: Sequence[Column], f: int) -> Column:
    """f - dot(a, b); called a distance elsewhere, but it is not the Hamming distance."""
    return (F.lit(f) - common_ones(a, b)).cast("int")


def cosine_bits(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Cosine of two 0/1 vectors; 0 when either is all zeros."""
    denom = F.sqrt(ones(a).cast("double") * ones(b).cast("double"))
    return F.when(denom == 0, F.lit(0.0)).otherwise(common_ones(a, b) / denom)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL when a norm is zero (no guard in the plain formula)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_guarded(a: Column, b: Column) -> Column:
    """Cosine used for ranking: zero vectors score 0."""
    return F.coalesce(cosine(a, b), F.lit(0.0))
