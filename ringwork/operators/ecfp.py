"""Extended-connectivity fingerprints: bits, counts, and counts of each exact radius.

A molecule's whole state is one row (arrays by atom), and a layer is a projection, so nothing is shuffled, whatever the radius; all of it runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwork.functions.hashing import counts, fold, layered, with_settled
from ringwork.functions.invariants import with_adjacency, with_atom_invariants, with_bond_invariants, with_centers

HELPERS = ("__adj", "__dox", "__inv", "__binv", "__nbh", "__live", "__seen", "__new", "__best", "__atoms")


def taken_in(layer: int):
    """(bonds, atom) -> what a live atom becomes in a layer: its bond set, invariant and place; null for a dead one."""

    def of(bonds: Column, i: Column) -> Column:
        sets = F.concat(F.get("__nbh", i), F.transform(bonds, lambda b: b["edge"]), F.flatten(F.transform(bonds, lambda b: F.get("__nbh", b["other"]))))
        pairs = F.array_sort(F.transform(bonds, lambda b: F.struct(F.get("__binv", b["edge"]).alias("bond"), F.get("__inv", b["other"]).alias("inv"))))
        new = F.struct(F.array_sort(F.array_distinct(sets)).alias("nbh"), layered(layer, F.get("__inv", i), pairs).alias("inv"), i.alias("atom"))
        return F.when(F.get("__live", i), new)

    return of


def with_layers(df: DataFrame, radius: int, mol: str = "mol", use_bond_types: bool = True, include_ring_membership: bool = True, atom_invariants: str | None = None, bond_invariants: str | None = None, out: str = "__layers") -> DataFrame:
    """df with out: for each radius from 0 on, the array of 32-bit hashes that it emits; null where mol is null.

    atom_invariants, bond_invariants: names of array<bigint> columns that stand in for the built-in ones.

    Layer 0 emits every atom's invariant. In each further layer a live atom takes in its bonds and its neighbours' bond sets; of the atoms with
    equal bond sets the one with the smallest new invariant (then place) emits, if no atom had that set before, and the others die. An atom without
    neighbours dies at once. An atom that wasn't computed in a layer has invariant 0 for the next.
    """
    df = with_centers(with_adjacency(df, mol), mol)
    df = df.withColumn("__inv", F.col(atom_invariants)) if atom_invariants else with_atom_invariants(df, mol, include_ring_membership)
    df = df.withColumn("__binv", F.col(bond_invariants)) if bond_invariants else with_bond_invariants(df, mol, use_bond_types)
    none = F.array().cast("array<int>")
    df = df.withColumns(
        {
            "__nbh": F.transform("__adj", lambda _: none),
            "__live": F.transform("__adj", lambda b: F.size(b) > 0),
            "__seen": F.array().cast("array<array<int>>"),
            "__layer0": F.col("__inv"),
        }
    )
    for k in range(radius):
        df = df.withColumn("__new", F.transform("__adj", taken_in(k)))
        # of equal bond sets the first in order wins: sorted by set, invariant and place, each set's first row stands behind another set's
        df = df.withColumn("__best", F.array_sort(F.filter("__new", lambda x: x.isNotNull())))
        first = lambda x, i: ((i == 0) | (F.get("__best", i - 1)["nbh"] != x["nbh"])) & ~F.array_contains("__seen", x["nbh"])
        df = df.withColumn("__best", F.filter("__best", first))
        df = df.withColumn("__atoms", F.transform("__best", lambda x: x["atom"]))
        after = {
            f"__layer{k + 1}": F.transform("__best", lambda x: x["inv"]),
            "__seen": F.concat("__seen", F.transform("__best", lambda x: x["nbh"])),
            "__live": F.transform("__new", lambda _, i: F.array_contains("__atoms", i)),
            "__nbh": F.zip_with("__nbh", "__new", lambda old, x: F.coalesce(x["nbh"], old)),
            "__inv": F.transform("__new", lambda x: F.coalesce(x["inv"], F.lit(0).cast("bigint"))),
        }
        df = df.withColumns(after)
    names = [f"__layer{k}" for k in range(radius + 1)]
    return df.withColumn(out, F.when(F.col(mol).isNotNull(), F.array(*names))).drop(*names, *HELPERS)


@dataclass(frozen=True)
class EcfpFingerprint:
    """Bits of the hashes of all layers up to a radius: struct<len, bits>."""

    radius: int = 2
    fp_size: int = 2048
    use_bond_types: bool = True
    include_ring_membership: bool = True
    atom_invariants: str | None = None
    bond_invariants: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.radius <= 255 or self.fp_size < 0:
            raise ValueError("radius must be 0 to 255, fp_size not negative")

    def with_use_bond_types(self, value: bool):
        return replace(self, use_bond_types=value)

    def with_include_ring_membership(self, value: bool):
        return replace(self, include_ring_membership=value)

    def layers(self, df: DataFrame, mol: str) -> DataFrame:
        return with_layers(df, self.radius, mol, self.use_bond_types, self.include_ring_membership, self.atom_invariants, self.bond_invariants)

    def value(self, layers: Column) -> Column:
        found = F.array_sort(F.array_distinct(fold(F.flatten(layers), self.fp_size)))
        return F.struct(F.lit(self.fp_size).alias("len"), found.alias("bits"))

    def compute(self, df: DataFrame, mol: str = "mol", out: str = "fp") -> DataFrame:
        """df with the fingerprint; null where mol is null, without bits where it has no atoms or fp_size is 0."""
        df = self.layers(df, mol)
        return with_settled(df, out, F.when(F.col(mol).isNotNull(), self.value(F.col("__layers")))).drop("__layers")


@dataclass(frozen=True)
class CountEcfpFingerprint(EcfpFingerprint):
    """Counts of the hashes of all layers: struct<len, counts>."""

    def value(self, layers: Column) -> Column:
        return F.struct(F.lit(self.fp_size).alias("len"), counts(fold(F.flatten(layers), self.fp_size)).alias("counts"))


@dataclass(frozen=True)
class LayeredCountEcfpFingerprint(EcfpFingerprint):
    """Counts of each exact radius: an array of radius + 1 struct<len, counts>."""

    def value(self, layers: Column) -> Column:
        return F.transform(layers, lambda h: F.struct(F.lit(self.fp_size).alias("len"), counts(fold(h, self.fp_size)).alias("counts")))
