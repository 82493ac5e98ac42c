"""Accessors of molecules as graphs, and their relational views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwork.functions.invariants import indexes, with_adjacency


def atom_count(mol: Column) -> Column:
    return F.size(mol["atoms"])


def is_empty_molecule(mol: Column) -> Column:
    return F.size(mol["atoms"]) == 0


def has_nodes(mol: Column) -> Column:
    return F.size(mol["atoms"]) > 0


def has_edges(mol: Column) -> Column:
    return F.size(mol["bonds"]) > 0


def nodes(mol: Column) -> Column:
    """Places of the atoms, 0 on."""
    return indexes(F.size(mol["atoms"]))


def edge_entries(mol: Column) -> Column:
    """Entries of a symmetric edge list: two for each bond."""
    return 2 * F.size(mol["bonds"])


def atom(mol: Column, place: Column | int) -> Column:
    """The atom at a place; null out of range."""
    return F.get(mol["atoms"], F.lit(place) if isinstance(place, int) else place)


def bonds(mol: Column, place: Column | int) -> Column:
    """The bonds at an atom; empty out of range."""
    return F.filter(mol["bonds"], lambda b: (b["a"] == place) | (b["b"] == place))


def other_node(bond: Column, place: Column | int) -> Column:
    """The other end of a bond; null if the atom is at neither."""
    return F.when(bond["a"] == place, bond["b"]).when(bond["b"] == place, bond["a"])


def with_neighbours(df: DataFrame, mol: str = "mol", out: str = "neighbours") -> DataFrame:
    """df with out: for each atom the sorted places of its neighbours; bonds that aren't the atom's, or lead nowhere, are left out."""
    df = with_adjacency(df, mol, "__near")
    return df.withColumn(out, F.transform("__near", lambda near: F.array_sort(F.transform(near, lambda b: b["other"])))).drop("__near")


def atoms_table(df: DataFrame, key: str = "mol_id", mol: str = "mol") -> DataFrame:
    """A row for each atom: key, atom, and its fields."""
    rows = df.select(key, F.posexplode_outer(f"{mol}.atoms").alias("atom", "x")).where("atom is not null")
    return rows.select(key, "atom", "x.*")


def bonds_table(df: DataFrame, key: str = "mol_id", mol: str = "mol") -> DataFrame:
    """A row for each bond: key, edge, and its fields."""
    rows = df.select(key, F.posexplode_outer(f"{mol}.bonds").alias("edge", "x")).where("edge is not null")
    return rows.select(key, "edge", "x.*")


def directed_table(df: DataFrame, key: str = "mol_id", mol: str = "mol") -> DataFrame:
    """Two rows for each bond: key, atom, other, edge, kind."""
    rows = bonds_table(df, key, mol)
    ends = F.explode(F.array(F.struct(F.col("a").alias("atom"), F.col("b").alias("other")), F.struct(F.col("b").alias("atom"), F.col("a").alias("other")))).alias("x")
    return rows.select(key, "edge", "kind", ends).select(key, "x.atom", "x.other", "edge", "kind")
