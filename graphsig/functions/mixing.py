"""Deterministic integer hashing for random choices (NodeSketch draws, hub buckets).

Python's RNG state cannot be shared across partitions, so every random choice is a pure function of
its coordinates. Values stay within 31 bits and every product within 62 bits, so no BIGINT overflow
happens under ANSI mode. Each mixing round is its own column so expressions stay linear in size.
(Walk steps use one MD5 expression instead, see ``operators.walks.step_hash``: a staged hash there
would be inlined into the join's inferred null filters.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed constants of the 31-bit mixer (odd multipliers below 2**31, and an additive offset).
MASK31 = 0x7FFFFFFF
MIX_A = 0x2C1B3C6D
MIX_B = 0x297A2D39
OFFSET = 0x1B873593


def node_key(node: Column) -> Column:
    """31-bit key of a node id: the first 8 hex digits of its MD5, masked."""
    return F.conv(F.substring(F.md5(node.cast("string")), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(MASK31))


def feature_key(node: Column) -> Column:
    """60-bit key of a node id (first 15 hex digits of its MD5): nodes do not merge at any real size."""
    return F.conv(F.substring(F.md5(node.cast("string")), 1, 15), 16, 10).cast("long")


def _lit(v: Column | int) -> Column:
    return v if isinstance(v, Column) else F.lit(int(v))


def with_hash(df: DataFrame, out: str, *coords: Column | int) -> DataFrame:
    """Add ``out`` = 31-bit hash of the coordinates, one mixing stage per column."""
    tmp = f"__{out}_h"
    df = df.withColumn(tmp, F.lit(0).cast("long"))
    for c in coords:
        c = _lit(c).cast("long").bitwiseAND(F.lit(MASK31))
        x = F.col(tmp).bitwiseXOR(c) + F.lit(OFFSET)
        df = df.withColumn(tmp, x.bitwiseAND(F.lit(MASK31)))
        df = df.withColumn(tmp, (F.col(tmp).bitwiseXOR(F.shiftright(F.col(tmp), 15)) * F.lit(MIX_A)).bitwiseAND(F.lit(MASK31)))
        df = df.withColumn(tmp, (F.col(tmp).bitwiseXOR(F.shiftright(F.col(tmp), 13)) * F.lit(MIX_B)).bitwiseAND(F.lit(MASK31)))
        df = df.withColumn(tmp, F.col(tmp).bitwiseXOR(F.shiftright(F.col(tmp), 16)))
    return df.withColumnRenamed(tmp, out)


def node_key_sql(node: str) -> str:
    return f"(('0x' || substr(md5({node}), 1, 8))::BIGINT & {MASK31})"
