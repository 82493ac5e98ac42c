"""Wrap-around 32-bit hashes on BIGINT columns, folding, and count simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B9
MASK = 0xFFFFFFFF
LEVELS = (1, 2, 4, 8)  # counts from which the bits of a simulated count are set


def u32(value: Column) -> Column:
    """A signed integer as an unsigned 32-bit one."""
    return value.cast("bigint").bitwiseAND(F.lit(MASK))


def combine(seed: Column, value: Column) -> Column:
    """seed xor (value + golden ratio + seed * 64 + seed / 4), modulo 2**32."""
    mixed = value + F.lit(GOLDEN) + F.shiftleft(seed, 6) + F.shiftright(seed, 2)
    return seed.bitwiseXOR(mixed.bitwiseAND(F.lit(MASK)))


def sequence_hash(values: Column, seed: Column | None = None) -> Column:
    """Fold of combine over an array of BIGINT, from 0 or a seed."""
    return F.aggregate(values, F.lit(0).cast("bigint") if seed is None else seed.cast("bigint"), combine)


def pair_hash(left: Column, right: Column) -> Column:
    return combine(combine(F.lit(0).cast("bigint"), left), right)


def layered(layer: int, center: Column, pairs: Column) -> Column:
    """Hash of a layer, an invariant, and its neighbours' (bond, invariant) pairs in order."""
    return F.aggregate(pairs, combine(F.lit(layer).cast("bigint"), center), lambda acc, p: combine(acc, pair_hash(p["bond"], p["inv"])))


def fold(hashes: Column, size: int) -> Column:
    """Array of hashes as indexes below size; none if size is 0."""
    if size <= 0:
        return F.array().cast("array<int>")
    if size & (size - 1) == 0:
        return F.transform(hashes, lambda h: h.bitwiseAND(F.lit(size - 1)).cast("int"))
    return F.transform(hashes, lambda h: (h % F.lit(size)).cast("int"))


def presence(hashes: Column, size: int) -> Column:
    """Sorted set bits of folded hashes."""
    return F.array_sort(F.array_distinct(fold(hashes, size)))


def counts(indexes: Column) -> Column:
    """Sorted array of (bit, cnt) of an array of indexes."""
    kinds = F.array_sort(F.array_distinct(indexes))
    return F.transform(kinds, lambda k: F.struct(k.alias("bit"), F.size(F.filter(indexes, lambda x: x == k)).cast("bigint").alias("cnt")))


def simulated(hashes: Column, size: int) -> Column:
    """Sorted bits of simulated counts: buckets of four bits, of which the k-th is set from LEVELS[k] hashes on; none if size is below 4."""
    buckets = size // len(LEVELS)
    if not buckets:
        return F.array().cast("array<int>")
    found = counts(fold(hashes, buckets))
    bits = F.transform(found, lambda c: F.filter(F.array(*[F.when(c["cnt"] >= n, c["bit"] * len(LEVELS) + k) for k, n in enumerate(LEVELS)]), lambda b: b.isNotNull()))
    return F.flatten(bits)


def settled(value: Column) -> Column:
    """The value, as one that the optimizer takes for non-deterministic.

    A fingerprint stands on many projections, each of which names columns below more than once. A filter, join or explode on the result would be pushed down
    through them all, and each name replaced by its expression, so that the plan grows as a power of the projections; through a column like this it is not.
    Nor is an array that a lambda names once put into the lambda in place of its name, where it would be made anew for each element.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def with_settled(df: DataFrame, out: str, value: Column) -> DataFrame:
    """df with a settled column, or in place of one of that name. It comes out of an array of one, behind which a join's keys are not traced back either."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.withColumn("__settled", settled(value)).select(*rest, F.explode(F.array("__settled")).alias(out))
