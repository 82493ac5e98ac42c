"""Atom-pair fingerprints: shortest distances between atoms, hashed with the codes of both ends; JVM expressions on one row per molecule."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwork.functions.hashing import presence, sequence_hash, settled, simulated, with_settled
from ringwork.functions.invariants import with_adjacency, with_atom_codes, with_centers, with_pi_electrons

FARTHEST = 254  # distances beyond are not told apart


def with_distances(df: DataFrame, farthest: int, adj: str = "__adj", out: str = "__dist") -> DataFrame:
    """df with out: for each atom the array of its distances to all atoms, null beyond `farthest` and in other parts; breadth first from each atom."""
    empty = F.array().cast("array<int>")
    steps = F.when((F.size(adj) > 1) & F.lit(farthest > 0), F.sequence(F.lit(1), F.least(F.lit(farthest), F.size(adj) - 1))).otherwise(empty)

    def step(acc: Column, d: Column) -> Column:
        reached = F.array_distinct(F.flatten(F.transform(acc["front"], lambda i: F.transform(F.get(F.col(adj), i), lambda b: b["other"]))))
        fresh = F.filter(reached, lambda i: F.get(acc["dist"], i).isNull())
        dist = F.when(F.size(fresh) > 0, F.transform(acc["dist"], lambda x, i: F.when(x.isNull() & F.array_contains(fresh, i), d).otherwise(x))).otherwise(acc["dist"])
        return F.struct(dist.alias("dist"), fresh.alias("front"))

    def of(_: Column, i: Column) -> Column:
        start = F.struct(F.transform(F.col(adj), lambda _, j: F.when(i == j, 0)).alias("dist"), F.array(i).alias("front"))
        return F.aggregate(steps, start, step)["dist"]

    return df.withColumn(out, settled(F.transform(adj, of)))


def with_pairs(df: DataFrame, nearest: int = 1, farthest: int = 30, dist: str = "__dist", out: str = "__pairs") -> DataFrame:
    """df with out: array of (a, b, d), a before b, of each pair at a distance from nearest to farthest."""

    def of(row: Column, i: Column) -> Column:
        found = F.transform(row, lambda d, j: F.struct(i.alias("a"), j.alias("b"), d.alias("d")))
        return F.filter(found, lambda p: (p["b"] > i) & (p["d"] >= max(nearest, 1)) & (p["d"] <= farthest))

    return df.withColumn(out, F.flatten(F.transform(dist, of)))


@dataclass(frozen=True)
class AtomPairFingerprint:
    """Bits of the pairs of atoms at min_distance to max_distance: struct<len, bits>. Works on prepared and on raw molecules.

    FARTHEST is the last distance that is told apart; a max_distance of one more takes in no more pairs.
    """

    fp_size: int = 2048
    min_distance: int = 1
    max_distance: int = 30
    count_simulation: bool = True
    atom_codes: str | None = None

    def __post_init__(self) -> None:
        if self.fp_size < 0 or not 0 <= self.min_distance or not 0 <= self.max_distance <= FARTHEST + 1:
            raise ValueError(f"fp_size and min_distance must not be negative, max_distance 0 to {FARTHEST + 1}")

    def with_min_distance(self, value: int) -> AtomPairFingerprint:
        return replace(self, min_distance=value)

    def with_max_distance(self, value: int) -> AtomPairFingerprint:
        return replace(self, max_distance=value)

    def with_count_simulation(self, value: bool) -> AtomPairFingerprint:
        return replace(self, count_simulation=value)

    def compute(self, df: DataFrame, mol: str = "mol", out: str = "fp") -> DataFrame:
        """df with the fingerprint; null where mol is null, without bits below two atoms or where fp_size is 0."""
        df = with_centers(with_adjacency(df, mol), mol)
        df = df.withColumn("__codes", F.col(self.atom_codes)) if self.atom_codes else with_atom_codes(with_pi_electrons(df, mol), mol)
        farthest = min(self.max_distance, FARTHEST)
        df = with_pairs(with_distances(df, farthest), self.min_distance, farthest)
        code = lambda i: F.get("__codes", i)
        hashes = F.transform("__pairs", lambda p: sequence_hash(F.array(F.least(code(p["a"]), code(p["b"])), p["d"].cast("bigint"), F.greatest(code(p["a"]), code(p["b"])))))
        df = df.withColumn("__hashes", hashes)
        bits = (simulated if self.count_simulation else presence)(F.col("__hashes"), self.fp_size)
        fp = F.struct(F.lit(self.fp_size).alias("len"), bits.alias("bits"))
        return with_settled(df, out, F.when(F.col(mol).isNotNull(), fp)).drop("__adj", "__dox", "__pi", "__codes", "__dist", "__pairs", "__hashes")
