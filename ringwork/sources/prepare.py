"""The one Python stage of the engine: SMILES to molecule structs, in Arrow batches; and what is added to molecules afterwards, in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ringwork.functions.elements import delta_mass
from ringwork.runtime import ship
from ringwork.schema import MOL
from ringwork.sources.perceive import find_rings, normalize
from ringwork.sources.smiles import Atom, Bond, Molecule, SmilesError, parse

TOGETHER = 500  # rows read together; a SMILES that comes again among them is read once


class PreparationError(ValueError):
    """A SMILES that can't be prepared."""


def as_row(mol: Molecule) -> dict:
    """A molecule as a value of schema.MOL."""
    atoms = [{"z": a.z, "charge": a.charge, "isotope": a.isotope, "aromatic": a.aromatic, "h_explicit": a.h_explicit, "h_implicit": a.h_implicit, "in_ring": a.in_ring, "comp": a.comp, "delta_mass": delta_mass(a.z, a.isotope)} for a in mol.atoms]
    bonds = [{"a": min(b.a, b.b), "b": max(b.a, b.b), "kind": b.kind, "in_ring": b.in_ring} for b in mol.bonds]
    return {"atoms": atoms, "bonds": bonds, "rings": mol.rings}


def as_molecule(row: dict) -> Molecule:
    atoms = [Atom(a["z"], a["charge"], a["isotope"], a["aromatic"], a["h_explicit"], a["h_implicit"], False, a["in_ring"], a["comp"]) for a in row["atoms"] or ()]
    return Molecule(atoms, [Bond(b["a"], b["b"], b["kind"], b["in_ring"]) for b in row["bonds"] or ()], row["rings"] or [])


def read_molecule(text: str | None, normalized: bool = True) -> tuple[dict | None, str | None]:
    """(molecule, error): one of them is null."""
    if text is None or not text.strip():
        return None, "an empty SMILES"
    try:
        mol = parse(text.strip())
        if normalized:
            normalize(mol)
        else:
            mol.rings = find_rings(mol)
    except SmilesError as e:
        return None, str(e)
    return as_row(mol), None


def prepare(df: DataFrame, smiles: str = "smiles", mode: str = "PERMISSIVE", normalized: bool = True, mol: str = "mol", error: str = "parse_error") -> DataFrame:
    """df with the molecules of its SMILES and, in `error`, why there is none.

    normalized: kekulized and perceived anew, as all fingerprints but those of raw graphs want it. mode: PERMISSIVE keeps rows without a molecule, DROPMALFORMED
    leaves them out, FAILFAST raises. Null and empty SMILES have no molecule. Columns named like the results are replaced. One pass, no shuffle.
    """
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode: {mode}")
    ship(df.sparkSession)
    source = df.drop(*[c for c in (mol, error) if c in df.columns and c != smiles])
    place = source.columns.index(smiles)
    names = [*source.columns, mol, error]
    kind = to_arrow_type(MOL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                found, held = [], {}
                for text in b.column(place).to_pylist():
                    if text not in held:
                        held[text] = read_molecule(text, normalized)
                    found.append(held[text])
                    if mode == "FAILFAST" and found[-1][1]:
                        raise PreparationError(f"{text!r}: {found[-1][1]}")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m for m, _ in found], kind), pa.array([e for _, e in found], pa.string())], names=names)

    out = source.mapInArrow(run, StructType([*source.schema.fields, StructField(mol, MOL), StructField(error, StringType())]))
    return out.where(F.col(mol).isNotNull()) if mode == "DROPMALFORMED" else out


def try_prepare(df: DataFrame, smiles: str = "smiles", **options) -> DataFrame:
    """prepare() that keeps what can't be prepared, with its error."""
    return prepare(df, smiles, "PERMISSIVE", **options)


def once_each(df: DataFrame, work: Callable[[DataFrame], DataFrame], smiles: str = "smiles") -> DataFrame:
    """df with the columns that work makes of its different SMILES, each taken once in the whole job; rows of which work keeps none are left out.

    work: a table of one column, smiles, to one that has smiles and its results, at most one row for each. The SMILES are dealt over as many tasks as the session
    shuffles to, however few files or row groups df is read from. The join is by sorting: nothing is broadcast, whatever the size.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # by a hash: dealt by smiles itself, as the distinct ones already are, the optimizer would drop the deal and read few small partitions in one task
    texts = df.select(F.col(smiles).alias("smiles")).distinct().repartition(width, F.xxhash64("smiles"))
    found = work(texts).withColumnRenamed("smiles", "__text").hint("merge")
    return df.join(found, F.col(smiles).eqNullSafe(F.col("__text"))).drop("__text")


# Names that users of older code may know.
smiles_ecfp_graph, smiles_ecfp_scratch = prepare, try_prepare


def explicit_h(mol: Column) -> Column:
    """The molecule with an atom and a single bond for each hydrogen, and no hydrogen counts."""
    atoms, bonds = mol["atoms"], mol["bonds"]
    owners = F.flatten(F.transform(atoms, lambda a, i: F.array_repeat(i, a["h_explicit"] + a["h_implicit"])))
    bare = F.transform(atoms, lambda a: a.withField("h_explicit", F.lit(0)).withField("h_implicit", F.lit(0)))
    no = F.lit(None).cast("int")
    hydrogen = lambda i: F.struct(F.lit(1).alias("z"), F.lit(0).alias("charge"), no.alias("isotope"), F.lit(False).alias("aromatic"), F.lit(0).alias("h_explicit"), F.lit(0).alias("h_implicit"), F.lit(False).alias("in_ring"), F.get(atoms, i)["comp"].alias("comp"), F.lit(0).alias("delta_mass"))
    added = F.transform(owners, lambda i, k: F.struct(i.alias("a"), (F.size(atoms) + k).alias("b"), F.lit("single").alias("kind"), F.lit(False).alias("in_ring")))
    return F.struct(F.concat(bare, F.transform(owners, hydrogen)).alias("atoms"), F.concat(bonds, added).alias("bonds"), mol["rings"].alias("rings"))
