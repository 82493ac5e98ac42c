"""Structural keys (MACCS, 167 bits). Patterns need a graph search, so they run in Python, in Arrow batches; keys that ask for single atoms, parts or aromatic rings
are also given as JVM expressions."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ringwork.functions.elements import NUMBERS
from ringwork.functions.invariants import HALOGENS
from ringwork.functions.maccs_keys import AROMATIC_RINGS, FRAGMENTS, PATTERNS, SIZE, THRESHOLDS, UNDEFINED
from ringwork.runtime import ship
from ringwork.schema import BITS
from ringwork.sources.prepare import as_molecule
from ringwork.sources.smarts import Pattern, SmartsError, Target
from ringwork.sources.smiles import Molecule

TOGETHER = 500  # rows looked at together; a molecule that comes again among them is searched once


class PatternError(ValueError):
    """A key whose pattern can't be read."""

    def __init__(self, key: int, why: str):
        super().__init__(f"key {key}: {why}")
        self.key = key


@dataclass(frozen=True)
class KeyDefinition:
    """A key: its pattern (None for special keys) and the number of matches that must be exceeded."""

    key: int
    pattern: str | None
    threshold: int
    special: str | None


def definitions() -> list[KeyDefinition]:
    special = {UNDEFINED: "undefined", AROMATIC_RINGS: "more than one aromatic ring", FRAGMENTS: "more than one fragment"}
    return [KeyDefinition(k, None if k in special else p, THRESHOLDS.get(k, 0), special.get(k)) for k, p in enumerate(PATTERNS, 1)]


def compiled() -> list[Pattern | None]:
    """The patterns by key, SIZE places; read once in each process."""
    held = sys.modules[__name__].__dict__.setdefault("_compiled", [])
    if not held:
        found: list[Pattern | None] = [None]
        for d in definitions():
            try:
                found.append(Pattern(d.pattern) if d.pattern else None)
            except SmartsError as e:
                raise PatternError(d.key, str(e)) from e
        held += found
    return held


def several_aromatic_rings(mol: Molecule) -> bool:
    aromatic = {(min(b.a, b.b), max(b.a, b.b)) for b in mol.bonds if b.kind == "aromatic"}
    return sum(all((min(p), max(p)) in aromatic for p in zip(r, [*r[1:], r[0]], strict=True)) for r in mol.rings if len(r) >= 2) > 1


def keys_of(mol: Molecule) -> list[int]:
    """The keys that a molecule sets, in order."""
    target = Target(mol)
    out = [k for k, p in enumerate(compiled()) if p and p.more_than(target, THRESHOLDS.get(k, 0))]
    if several_aromatic_rings(mol):
        out.append(AROMATIC_RINGS)
    if any(a.comp != mol.atoms[0].comp for a in mol.atoms):
        out.append(FRAGMENTS)
    return sorted(out)


def aromatic_ring_count(mol: Column) -> Column:
    """Rings all of whose bonds are aromatic."""
    aromatic = F.transform(F.filter(mol["bonds"], lambda b: b["kind"] == "aromatic"), lambda b: F.struct(F.least(b["a"], b["b"]).alias("a"), F.greatest(b["a"], b["b"]).alias("b")))

    def closed(ring: Column) -> Column:
        pairs = F.transform(ring, lambda x, i: F.struct(x.alias("x"), F.get(ring, (i + 1) % F.size(ring)).alias("y")))
        return F.forall(pairs, lambda p: F.array_contains(aromatic, F.struct(F.least(p["x"], p["y"]).alias("a"), F.greatest(p["x"], p["y"]).alias("b"))))

    return F.size(F.filter(mol["rings"], lambda r: (F.size(r) >= 2) & closed(r)))


def fragment_count(mol: Column) -> Column:
    return F.size(F.array_distinct(F.transform(mol["atoms"], lambda a: a["comp"])))


def atom_keys(mol: Column) -> Column:
    """Sorted array of the special keys and of those that ask for single atoms; JVM expressions only. Explicit hydrogens don't count as an atom's hydrogens here."""
    z = lambda *symbols: (lambda a: a["z"].isin(*[NUMBERS[s] if isinstance(s, str) else s for s in symbols]))
    group = lambda text: z(*text.split())
    h = lambda a: a["h_explicit"] + a["h_implicit"]
    carbon = lambda *hs: (lambda a: (a["z"] == 6) & ~a["aromatic"] & h(a).isin(*hs))
    hetero = lambda a: ~a["z"].isin(1, 6)
    tests = {
        2: z(104), 3: z(32, 33, 34, 50, 51, 52, 82, 83, 84), 4: group("Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"), 5: group("Sc Ti Y Zr Hf"),
        6: group("La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu"), 7: group("V Cr Mn Nb Mo Tc Ta W Re"), 9: group("Fe Co Ni Ru Rh Pd Os Ir Pt"), 10: group("Be Mg Ca Sr Ba Ra"),
        12: group("Cu Zn Ag Cd Au Hg"), 18: z(5, 13, 31, 49, 81), 20: z(14), 27: z(53), 29: z(15), 35: group("Li Na K Rb Cs Fr"), 36: lambda a: (a["z"] == 16) & a["in_ring"],
        42: z(9), 44: lambda a: ~a["z"].isin(1, 6, 7, 8, 9, 14, 15, 16, 17, 35, 53), 46: z(35), 49: lambda a: a["charge"] != 0, 57: lambda a: (a["z"] == 8) & a["in_ring"],
        84: lambda a: (a["z"] == 7) & ~a["aromatic"] & (h(a) == 2), 88: z(16), 103: z(17), 120: lambda a: (a["z"] != 6) & a["in_ring"], 121: lambda a: (a["z"] == 7) & a["in_ring"],
        131: lambda a: hetero(a) & (h(a) > 0), 134: z(9, *HALOGENS), 137: lambda a: (a["z"] != 6) & a["in_ring"], 139: lambda a: (a["z"] == 8) & ~a["aromatic"] & (h(a) > 0),
        140: z(8), 141: carbon(3), 142: z(7), 146: z(8), 149: carbon(3, 4), 151: lambda a: (a["z"] == 7) & (h(a) > 0), 159: z(8), 160: carbon(3, 4), 161: z(7), 162: lambda a: a["aromatic"],
        164: z(8), 165: lambda a: a["in_ring"],
    }
    flags = {k: F.size(F.filter(mol["atoms"], test)) > THRESHOLDS.get(k, 0) for k, test in tests.items()}
    flags |= {AROMATIC_RINGS: aromatic_ring_count(mol) > 1, FRAGMENTS: fragment_count(mol) > 1}
    return F.filter(F.array(*[F.when(flags[k], k) for k in sorted(flags)]), lambda k: k.isNotNull())


@dataclass(frozen=True)
class MaccsFingerprint:
    """The structural keys: struct<len, bits>, len 167."""

    def __post_init__(self) -> None:
        compiled()

    def compute(self, df: DataFrame, mol: str = "mol", out: str = "fp") -> DataFrame:
        """df with the keys of its molecules; null where mol is null. One pass, no shuffle. A column named like the result is replaced."""
        ship(df.sparkSession)
        source = df.drop(out) if out in df.columns else df
        place, names, kind = source.columns.index(mol), [*source.columns, out], to_arrow_type(BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, TOGETHER):
                    b = whole.slice(at, TOGETHER)
                    found, held = [], {}
                    for row in b.column(place).to_pylist():
                        if row is None:
                            found.append(None)
                            continue
                        key = tuple((a["z"], a["charge"], a["aromatic"], a["h_explicit"] + a["h_implicit"], a["in_ring"], a["comp"]) for a in row["atoms"]), tuple((b["a"], b["b"], b["kind"], b["in_ring"]) for b in row["bonds"]), str(row["rings"])
                        if key not in held:
                            held[key] = {"len": SIZE, "bits": keys_of(as_molecule(row))}
                        found.append(held[key])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=names)

        return source.mapInArrow(run, StructType([*source.schema.fields, StructField(out, BITS)]))
