"""Accessors of fingerprint values: bits struct<len, bits>, counts struct<len, counts array<struct<bit, cnt>>>, layers array of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MAX = 0xFFFFFFFF


def zeros(size: int) -> Column:
    """A bit fingerprint with no bit set."""
    return F.struct(F.lit(size).alias("len"), F.array().cast("array<int>").alias("bits"))


def from_bits(flags: Column) -> Column:
    """A bit fingerprint of an array of booleans."""
    positions = F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    return F.struct(F.size(flags).alias("len"), positions.alias("bits"))


def contains(fp: Column, bit: Column | int) -> Column:
    """Whether a bit is set; false out of range."""
    return F.array_contains(fp["bits"], bit)


def set_bit(fp: Column, bit: Column | int) -> Column:
    """With the bit set; unchanged out of range."""
    value = F.lit(bit) if isinstance(bit, int) else bit
    inside = (value >= 0) & (value < fp["len"])
    bits = F.when(inside, F.array_sort(F.array_distinct(F.concat(fp["bits"], F.array(value.cast("int")))))).otherwise(fp["bits"])
    return F.struct(fp["len"].alias("len"), bits.alias("bits"))


def as_bitslice(fp: Column) -> Column:
    """Array of booleans of the whole length."""
    return F.when(fp["len"] > 0, F.transform(F.sequence(F.lit(0), fp["len"] - 1), lambda i: F.array_contains(fp["bits"], i))).otherwise(F.array().cast("array<boolean>"))


def active_bits(fp: Column) -> Column:
    return fp["bits"]


def length(fp: Column) -> Column:
    return fp["len"]


def is_empty(fp: Column) -> Column:
    """Whether the length is 0 (not: whether no bit is set)."""
    return fp["len"] == 0


def count_zeros(size: int) -> Column:
    return F.struct(F.lit(size).alias("len"), F.array().cast("array<struct<bit:int,cnt:bigint>>").alias("counts"))


def from_counts(values: Column) -> Column:
    """A count fingerprint of an array of counts."""
    found = F.transform(values, lambda c, i: F.struct(i.alias("bit"), c.cast("bigint").alias("cnt")))
    return F.struct(F.size(values).alias("len"), F.filter(found, lambda x: x["cnt"] > 0).alias("counts"))


def count(fp: Column, bit: Column | int) -> Column:
    """Count at a bit; 0 out of range."""
    return F.coalesce(F.get(F.filter(fp["counts"], lambda x: x["bit"] == bit), F.lit(0))["cnt"], F.lit(0).cast("bigint"))


def active_counts(fp: Column) -> Column:
    return fp["counts"]


def as_slice(fp: Column) -> Column:
    """Array of counts of the whole length: for each count the zeros since the one before and itself, then the zeros to the end; not a search for each place."""
    zero = F.lit(0).cast("bigint")
    inside = F.array_sort(F.filter(fp["counts"], lambda c: (c["bit"] >= 0) & (c["bit"] < fp["len"])))
    starts = F.concat(F.array(F.lit(0)), F.transform(inside, lambda c: c["bit"] + 1))
    part = lambda c, start: F.when(c.isNull(), F.array_repeat(zero, fp["len"] - start)).otherwise(F.concat(F.array_repeat(zero, c["bit"] - start), F.array(c["cnt"])))
    return F.when(fp["len"] > 0, F.flatten(F.zip_with(inside, starts, part))).otherwise(F.array().cast("array<bigint>"))


def increment(fp: Column, bit: Column | int) -> Column:
    """With one more at a bit, up to 2**32 - 1; unchanged out of range."""
    value = F.lit(bit) if isinstance(bit, int) else bit
    more = F.least(count(fp, value) + 1, F.lit(U32_MAX).cast("bigint"))
    rest = F.filter(fp["counts"], lambda x: x["bit"] != value)
    new = F.array_sort(F.concat(rest, F.array(F.struct(value.cast("int").alias("bit"), more.alias("cnt")))))
    return F.struct(fp["len"].alias("len"), F.when((value >= 0) & (value < fp["len"]), new).otherwise(fp["counts"]).alias("counts"))


def layered_zeros(layers: int, size: int) -> Column:
    return F.array_repeat(count_zeros(size), layers)


def layers(fp: Column) -> Column:
    return fp


def layer(fp: Column, radius: int) -> Column:
    """The counts of an exact radius; null out of range."""
    return F.get(fp, F.lit(radius))


def formula(fp: Column) -> Column:
    """The counts of radius 0; null without layers."""
    return layer(fp, 0)


def layer_count(fp: Column) -> Column:
    return F.size(fp)


def has_no_layers(fp: Column) -> Column:
    return F.size(fp) == 0


def increment_layer(fp: Column, radius: int, bit: Column | int) -> Column:
    """With one more at a bit of a layer; unchanged out of range."""
    return F.transform(fp, lambda x, i: F.when(i == radius, increment(x, bit)).otherwise(x))
