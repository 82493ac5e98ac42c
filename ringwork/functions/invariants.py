"""Atom and bond invariants of prepared molecules, as array columns beside them; JVM expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwork.functions.hashing import sequence_hash, settled, u32

HALOGENS = (17, 35, 53)
# Atomic numbers with a type of their own in pair and torsion codes; all others share the last type.
TYPES = (5, 6, 7, 8, 9, 14, 15, 16, 17, 33, 34, 35, 51, 52, 53)


def indexes(size: Column) -> Column:
    """0 .. size - 1, empty for 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def order_of(kind: Column) -> Column:
    """Bond order; aromatic bonds and stereo marks count as one."""
    return F.when(kind == "double", 2).when(kind == "triple", 3).when(kind == "quadruple", 4).otherwise(1)


def total_h(atom: Column) -> Column:
    return atom["h_explicit"] + atom["h_implicit"]


def with_adjacency(df: DataFrame, mol: str = "mol", out: str = "__adj") -> DataFrame:
    """df with out: for each atom its bonds (other, edge, order, kind). Bonds with an end that is no atom, or both at one atom, are left out; of
    several bonds between two atoms the first counts."""
    atoms, bonds = F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds")
    df = df.withColumn("__n", F.coalesce(F.size(atoms), F.lit(0)))
    n = F.col("__n")
    ends = F.transform(bonds, lambda b, k: F.struct(F.least(b["a"], b["b"]).alias("a"), F.greatest(b["a"], b["b"]).alias("b"), k.alias("edge"), order_of(b["kind"]).alias("order"), b["kind"].alias("kind")))
    df = df.withColumn("__ends", F.filter(ends, lambda b: (b["a"] >= 0) & (b["b"] < n) & (b["a"] != b["b"])))
    df = df.withColumn("__ends", F.filter("__ends", lambda b: ~F.exists("__ends", lambda c: (c["a"] == b["a"]) & (c["b"] == b["b"]) & (c["edge"] < b["edge"]))))
    at = lambda i: F.transform(F.filter("__ends", lambda b: (b["a"] == i) | (b["b"] == i)), lambda b: F.struct(F.when(b["a"] == i, b["b"]).otherwise(b["a"]).alias("other"), b["edge"].alias("edge"), b["order"].alias("order"), b["kind"].alias("kind")))
    return df.withColumn(out, F.transform(indexes(n), at)).drop("__ends", "__n")


def with_centers(df: DataFrame, mol: str = "mol", adj: str = "__adj", out: str = "__dox") -> DataFrame:
    """df with out: for each atom the number of its oxygens by bonds of order two or more, if it is a halogen that has an oxygen by a single bond too; else 0."""
    z = lambda i: F.get(F.col(f"{mol}.atoms"), i)["z"]

    def of(bonds: Column, i: Column) -> Column:
        double = F.size(F.filter(bonds, lambda b: (z(b["other"]) == 8) & (b["order"] >= 2)))
        single = F.exists(bonds, lambda b: (z(b["other"]) == 8) & (b["order"] == 1))
        return F.when(z(i).isin(*HALOGENS) & single, double).otherwise(0)

    return df.withColumn(out, F.transform(adj, of))


def normalized_charge(mol: str, adj: str, dox: str):
    """atom index -> charge: of a halogen center its doubly bound oxygens, of such an oxygen -1, else as stored."""

    def of(i: Column) -> Column:
        atom = F.get(F.col(f"{mol}.atoms"), i)
        double = F.exists(F.get(F.col(adj), i), lambda b: (b["order"] >= 2) & (F.get(F.col(dox), b["other"]) > 0))
        return F.when(F.get(F.col(dox), i) > 0, F.get(F.col(dox), i)).when((atom["z"] == 8) & double, -1).otherwise(atom["charge"])

    return of


def with_atom_invariants(df: DataFrame, mol: str = "mol", include_ring_membership: bool = True, adj: str = "__adj", dox: str = "__dox", out: str = "__inv") -> DataFrame:
    """df with out: hash of atomic number, degree with hydrogens, hydrogens, charge, mass difference, and 1 for ring atoms if wanted."""
    charge = normalized_charge(mol, adj, dox)

    def of(atom: Column, i: Column) -> Column:
        bonds = F.get(F.col(adj), i)
        h_bonds = F.size(F.filter(bonds, lambda b: F.get(F.col(f"{mol}.atoms"), b["other"])["z"] == 1))
        hydrogens = total_h(atom) + h_bonds
        parts = [atom["z"], F.size(bonds) - h_bonds + hydrogens, hydrogens, charge(i), atom["delta_mass"]]
        values = F.array(*map(u32, parts))
        if include_ring_membership:
            values = F.when(atom["in_ring"], F.concat(values, F.array(F.lit(1).cast("bigint")))).otherwise(values)
        return sequence_hash(values)

    return df.withColumn(out, F.transform(F.col(f"{mol}.atoms"), of))


def with_bond_invariants(df: DataFrame, mol: str = "mol", use_bond_types: bool = True, dox: str = "__dox", out: str = "__binv") -> DataFrame:
    """df with out: for each bond 1 to 4 by its order and 12 if it is aromatic; 1 between an oxygen and a halogen one of which is a center, and for all without types."""
    z = lambda i: F.get(F.col(f"{mol}.atoms"), i)["z"]
    center = lambda i: F.coalesce(F.get(F.col(dox), i), F.lit(0)) > 0

    def of(b: Column) -> Column:
        oxo = ((z(b["a"]) == 8) & z(b["b"]).isin(*HALOGENS)) | ((z(b["b"]) == 8) & z(b["a"]).isin(*HALOGENS))
        value = F.when(F.coalesce(oxo, F.lit(False)) & (center(b["a"]) | center(b["b"])), 1).when(b["kind"] == "aromatic", 12).otherwise(order_of(b["kind"]))
        return value.cast("bigint")

    return df.withColumn(out, F.transform(F.col(f"{mol}.bonds"), of if use_bond_types else lambda b: F.lit(1).cast("bigint")))


def other_pi(z: Column, degree: Column, unsat: Column, single: Column) -> Column:
    """Pi electrons of unsaturated atoms of elements without a type of their own."""
    zero = F.lit(0)
    keep = lambda yes: F.when(yes, unsat).otherwise(zero)
    manganese = F.when(degree == 1, unsat).when((degree == 2) & ~single, F.when(unsat == 4, 1).otherwise(unsat)).otherwise(zero)
    chromium = F.when(degree.isin(1, 2), unsat).when(degree == 3, keep(unsat >= 2)).otherwise(zero)
    iron = F.when(degree == 1, keep(unsat >= 2)).when(degree == 3, keep(unsat == 1)).when(degree == 4, keep(unsat == 2)).otherwise(zero)
    cobalt = F.when(degree.isin(2, 3), keep(unsat == 1)).when(degree == 4, keep(unsat == 2)).otherwise(zero)
    return (
        F.when(z.isin(25, 43, 75), manganese).when(z.isin(24, 42, 74, 90, 92, 93), chromium).when(z.isin(23, 41, 73), keep(degree <= 3))
        .when(z.isin(26, 44, 76), iron).when(z.isin(27, 45, 77), cobalt).when(z.isin(28, 46, 78, 66), keep(unsat == degree)).when(z == 65, zero).otherwise(unsat)
    )


def with_pi_electrons(df: DataFrame, mol: str = "mol", adj: str = "__adj", dox: str = "__dox", out: str = "__pi") -> DataFrame:
    """df with out: pi electrons of each atom, as pair and torsion codes count them."""
    z_at = lambda i: F.get(F.col(f"{mol}.atoms"), i)["z"]

    def of(atom: Column, i: Column) -> Column:
        bonds, z = F.get(F.col(adj), i), atom["z"]
        degree = F.size(bonds)
        unsat = F.aggregate(bonds, F.lit(0), lambda acc, b: acc + b["order"] - 1)
        single = F.exists(bonds, lambda b: b["order"] == 1)
        oxo = F.exists(bonds, lambda b: z_at(b["other"]).isin(*HALOGENS) & (F.size(F.get(F.col(adj), b["other"])) >= 2) & (b["order"] >= 2) & (F.get(F.col(dox), b["other"]) > 0))
        phosphorus = ((degree <= 2) & ~((degree == 2) & (total_h(atom) == 2))) | ((degree == 3) & (total_h(atom) == 0))
        one = F.when(~single, 1).when(atom["charge"] > 0, F.when(degree <= 3, 1).otherwise(0)).when(degree == 4, 1).otherwise(0)
        sulfur = F.when(degree == 2, unsat).when(unsat == 1, one).when(single, 0).otherwise(unsat)
        return (
            F.when(atom["aromatic"], 1).when(z == 0, 0).when((z == 8) & oxo, 0).when(unsat == 0, 0).when(~z.isin(*TYPES), other_pi(z, degree, unsat, single))
            .when(z.isin(*HALOGENS), F.when(degree >= 2, 0).otherwise(unsat)).when(z.isin(15, 33, 51), F.when(phosphorus, unsat).otherwise(0)).when(z.isin(16, 34, 52), sulfur).otherwise(unsat)
        )

    return df.withColumn(out, settled(F.transform(F.col(f"{mol}.atoms"), of)))


def with_atom_codes(df: DataFrame, mol: str = "mol", subtract: int = 0, adj: str = "__adj", pi: str = "__pi", out: str = "__codes") -> DataFrame:
    """df with out: (degree % 7) | (pi % 3) << 3 | type << 5 of each atom; from the degree, explicit hydrogens included, `subtract` is taken, down to 0."""
    table = F.array(*map(F.lit, TYPES))

    def of(atom: Column, i: Column) -> Column:
        kind = F.coalesce(F.nullif(F.array_position(table, atom["z"]), F.lit(0).cast("bigint")) - 1, F.lit(len(TYPES)).cast("bigint"))
        degree = F.greatest(F.size(F.get(F.col(adj), i)) - subtract, F.lit(0))
        code = (degree % 7) + (F.get(F.col(pi), i) % 3) * 8
        return code.cast("bigint") + kind * 32

    return df.withColumn(out, settled(F.transform(F.col(f"{mol}.atoms"), of)))
