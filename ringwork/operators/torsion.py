"""Topological-torsion fingerprints: paths of a number of atoms, hashed by their atoms' codes; JVM expressions on one row per molecule."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwork.functions.hashing import presence, sequence_hash, simulated, with_settled
from ringwork.functions.invariants import with_adjacency, with_atom_codes, with_centers, with_pi_electrons
from ringwork.operators.atom_pair import with_distances

MOST_ATOMS = 7


def canonical(atoms: Column, k: int) -> Column:
    """Whether a path is the one of its ways around that counts: an open path that is not after its reverse, a closed one that is the first of its turns and their reverses."""
    turns = []
    for start in range(k - 1):
        turn = [F.get(atoms, F.lit((start + j) % (k - 1))) for j in range(k - 1)]
        turn = F.array(*turn, turn[0])
        turns += [turn, F.reverse(turn)]
    closed = F.get(atoms, F.lit(0)) == F.get(atoms, F.lit(k - 1))
    return F.when(closed, atoms == F.array_min(F.array(*turns))).otherwise(atoms <= F.reverse(atoms))


def with_paths(df: DataFrame, k: int = 4, only_shortest: bool = False, adj: str = "__adj", dist: str = "__dist", out: str = "__paths") -> DataFrame:
    """df with out: arrays of the k atoms of each path that uses no bond twice, once for each path. only_shortest: those whose ends are k - 1 apart."""
    df = df.withColumn("__walks", F.transform(adj, lambda _, i: F.struct(F.array(i).alias("atoms"), F.array().cast("array<int>").alias("edges"))))
    for _ in range(k - 1):

        def grow(w: Column) -> Column:
            onward = F.filter(F.get(F.col(adj), F.element_at(w["atoms"], -1)), lambda b: ~F.array_contains(w["edges"], b["edge"]))
            return F.transform(onward, lambda b: F.struct(F.concat(w["atoms"], F.array(b["other"])).alias("atoms"), F.concat(w["edges"], F.array(b["edge"])).alias("edges")))

        df = df.withColumn("__walks", F.flatten(F.transform("__walks", grow)))
    paths = F.filter(F.transform("__walks", lambda w: w["atoms"]), lambda p: canonical(p, k))
    if only_shortest:
        paths = F.filter(paths, lambda p: F.coalesce(F.get(F.get(F.col(dist), F.get(p, F.lit(0))), F.get(p, F.lit(k - 1))) == k - 1, F.lit(False)))
    return df.withColumn(out, paths).drop("__walks")


@dataclass(frozen=True)
class TopologicalTorsionFingerprint:
    """Bits of the paths of torsion_atom_count atoms: struct<len, bits>. Works on prepared and on raw molecules.

    end_codes, inner_codes: names of array<bigint> columns that stand in for the built-in codes of ends and of the atoms between.
    """

    fp_size: int = 2048
    torsion_atom_count: int = 4
    count_simulation: bool = True
    only_shortest_paths: bool = False
    end_codes: str | None = None
    inner_codes: str | None = None

    def __post_init__(self) -> None:
        if self.fp_size < 0:
            raise ValueError("fp_size must not be negative")
        if self.fp_size and self.torsion_atom_count > MOST_ATOMS:
            raise ValueError(f"torsion_atom_count must be at most {MOST_ATOMS}")

    def with_torsion_atom_count(self, value: int) -> TopologicalTorsionFingerprint:
        return replace(self, torsion_atom_count=value)

    def with_count_simulation(self, value: bool) -> TopologicalTorsionFingerprint:
        return replace(self, count_simulation=value)

    def with_only_shortest_paths(self, value: bool) -> TopologicalTorsionFingerprint:
        return replace(self, only_shortest_paths=value)

    def compute(self, df: DataFrame, mol: str = "mol", out: str = "fp") -> DataFrame:
        """df with the fingerprint; null where mol is null, without bits below torsion_atom_count atoms, below paths of two, or where fp_size is 0."""
        k = self.torsion_atom_count
        if k < 2 or not self.fp_size:
            none = F.struct(F.lit(self.fp_size).alias("len"), F.array().cast("array<int>").alias("bits"))
            return df.withColumn(out, F.when(F.col(mol).isNotNull(), none))
        df = with_centers(with_adjacency(df, mol), mol)
        df = with_pi_electrons(df, mol)
        df = df.withColumn("__end", F.col(self.end_codes)) if self.end_codes else with_atom_codes(df, mol, 1, out="__end")
        df = df.withColumn("__inner", F.col(self.inner_codes)) if self.inner_codes else with_atom_codes(df, mol, 2, out="__inner")
        if self.only_shortest_paths:
            df = with_distances(df, k - 1)
        df = with_paths(df, k, self.only_shortest_paths)
        codes = F.transform("__paths", lambda p: F.transform(p, lambda a, j: F.when((j == 0) | (j == k - 1), F.get("__end", a)).otherwise(F.get("__inner", a))))
        df = df.withColumn("__codes", codes).withColumn("__hashes", F.transform("__codes", lambda c: sequence_hash(F.least(c, F.reverse(c)))))
        bits = (simulated if self.count_simulation else presence)(F.col("__hashes"), self.fp_size)
        fp = F.struct(F.lit(self.fp_size).alias("len"), bits.alias("bits"))
        return with_settled(df, out, F.when(F.col(mol).isNotNull(), fp)).drop("__adj", "__dox", "__pi", "__end", "__inner", "__dist", "__paths", "__codes", "__hashes")
