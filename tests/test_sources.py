"""Reading SMILES: the parser, perception, the sources, streams."""

import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringwork.functions.elements import delta_mass
from ringwork.functions.hashing import GOLDEN, MASK
from ringwork.functions.invariants import with_adjacency, with_atom_invariants, with_centers, with_pi_electrons
from ringwork.operators.ecfp import EcfpFingerprint
from ringwork.operators.maccs import compiled, definitions, keys_of
from ringwork.sources.perceive import normalize
from ringwork.sources.prepare import PreparationError, prepare, read_molecule
from ringwork.sources.readers import guarded, molecules, read_expected, read_smiles
from ringwork.sources.smarts import Pattern, SmartsError, Target
from ringwork.sources.smiles import SmilesError, parse
from ringwork.streaming.fingerprints import fingerprinted, smiles_stream, write_parquet

# Known atom invariants.
WITH_RING = {"CN": [2246728737, 847957139], "O=C=O": [864942730, 2245900962, 864942730], "c1ccncc1": [3218693969] * 3 + [2041434490] + [3218693969] * 2, "[NH4+]": [847680145], "[13CH4]": [2246733040], "C[NH3+]": [2246728737, 847694221]}
WITHOUT = {"c1ccccc1": [2246703798] * 6, "C1CCCCC1": [2245384272] * 6, "C1=CC=CN=C1": [2246703798] * 4 + [847336149, 2246703798], "OC1CCCCC1": [864662311, 2245273601] + [2245384272] * 5}
PI = {"O=Cl(=O)O": [0, 0, 0, 0], "O=Br(=O)O": [0, 0, 0, 0], "O=S=O": [1, 2, 1], "c1ccccc1": [1] * 6, "*": [0], "OP(=O)O": [0, 0, 1, 0]}


@pytest.mark.parametrize(("text", "hydrogens", "aromatic"), [("CCO", [3, 2, 1], 0), ("C1=CC=CC=C1", [1] * 6, 6), ("c1cc[nH]c1", [1] * 5, 5), ("OCl(=O)=O", [1, 0, 0, 0], 0), ("C1=CC=CN=C1", [1, 1, 1, 1, 0, 1], 6), ("O=C1C=CC(=O)C=C1", [0, 0, 1, 1, 0, 0, 1, 1], 0), ("[cH-]1cccc1", [1] * 5, 5), ("N(=O)(=O)C", [0, 0, 0, 3], 0), ("C%10CC%10", [2, 2, 2], 0), ("F/C=C\\F", [0, 1, 1, 0], 0)])
def test_reading(text, hydrogens, aromatic):
    mol = normalize(parse(text))
    assert [a.h_explicit + a.h_implicit for a in mol.atoms] == hydrogens and sum(a.aromatic for a in mol.atoms) == aromatic


def test_fused_systems():
    azulene, naphthalene = normalize(parse("c1ccc2cccc2cc1")), normalize(parse("c1ccc2ccccc2c1"))
    assert [b.kind for b in azulene.bonds].count("aromatic") == 10 and [b.kind for b in naphthalene.bonds].count("aromatic") == 11
    assert sorted(map(len, azulene.rings)) == [5, 7] and len(normalize(parse("C12C3C4C1C5C2C3C45")).rings) == 6
    biphenyl = normalize(parse("c1ccccc1c1ccccc1"))
    assert [b.kind for b in biphenyl.bonds].count("single") == 1


def test_what_cannot_be_kekulized_stays():
    mol = normalize(parse("n1cccc1"))
    assert all(a.aromatic for a in mol.atoms)


@pytest.mark.parametrize("text", ["", "C(", "C)", "C1CC", "[C", "C=", "=C", "X", "[Xx]", "C..C", "C.", "(C)", "C()C", "C11", "C==C", "[C++2]", "1CC1", "C%1"])
def test_not_smiles(text):
    with pytest.raises(SmilesError):
        parse(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="CNOcn()=#123[]+-H.FSlr*%/\\", min_size=1, max_size=40))
def test_any_text_is_read_or_refused(text):
    mol, error = read_molecule(text)
    assert (mol is None) != (error is None)
    if mol:
        n = len(mol["atoms"])
        assert all(0 <= b["a"] < b["b"] < n for b in mol["bonds"]) and all(len(r) >= 3 for r in mol["rings"])
        again = normalize(parse(text.strip()))
        assert keys_of(again) == sorted(set(keys_of(again))) and all(0 < k < 167 for k in keys_of(again))


def test_masses():
    assert (delta_mass(6, 14), delta_mass(6, 13), delta_mass(1, 2), delta_mass(6, None), delta_mass(0, 3), delta_mass(6, 400), delta_mass(8, 18)) == (1, 0, 1, 0, 0, 0, 2)
    assert delta_mass(92, 235) == -2


@pytest.mark.parametrize(("known", "ring"), [(WITH_RING, True), (WITHOUT, False)])
def test_atom_invariants(spark, known, ring):
    df = with_centers(with_adjacency(prepare(spark.createDataFrame([(s,) for s in known], "smiles string"))))
    assert {r["smiles"]: r["__inv"] for r in with_atom_invariants(df, include_ring_membership=ring).collect()} == known


def test_pi_electrons(spark):
    df = with_pi_electrons(with_centers(with_adjacency(prepare(spark.createDataFrame([(s,) for s in PI], "smiles string")))))
    assert {r["smiles"]: r["__pi"] for r in df.collect()} == PI


def test_hash_columns(spark):
    from pyspark.sql import functions as F

    from ringwork.functions.hashing import fold, pair_hash, sequence_hash, simulated

    def combine(s, v):
        return s ^ ((v + GOLDEN + (s << 6) + (s >> 2)) & MASK)

    values = [6, 4294967295, 17, 0]
    want = 0
    for v in values:
        want = combine(want, v)
    r = spark.range(1).select(sequence_hash(F.array(*[F.lit(v).cast("bigint") for v in values])).alias("h"), pair_hash(F.lit(6).cast("bigint"), F.lit(4294967295).cast("bigint")).alias("p"), fold(F.array(F.lit(25).cast("bigint")), 10).alias("f"), simulated(F.array(*[F.lit(5).cast("bigint")] * 4), 16).alias("s"), simulated(F.array(F.lit(5).cast("bigint")), 3).alias("t")).first()
    assert r["h"] == want and r["p"] == combine(combine(0, 6), 4294967295) and r["f"] == [5] and r["s"] == [4, 5, 6] and r["t"] == []


def test_patterns():
    assert len([p for p in compiled() if p]) == 163 and len(definitions()) == 166
    ring = Target(normalize(parse("C1CCCCC1")))
    assert Pattern("*1~*~*~*~*~*~1").more_than(ring, 0) and not Pattern("*1~*~*~*~*~*~1").more_than(ring, 1)
    assert Pattern("[C;H2,H3][!#6;!#1][C;H2,H3]").more_than(Target(normalize(parse("CCOCC"))), 0)
    for text in ("[", "[]", "C(", "C1", "[Q]"):
        with pytest.raises((SmartsError, IndexError)):
            Pattern(text)


def test_modes(spark):
    df = spark.createDataFrame([("CCO",), ("C(",), (None,), ("",)], "smiles string")
    rows = {r["smiles"]: r for r in prepare(df).collect()}
    assert rows["CCO"]["mol"] and not rows["CCO"]["parse_error"] and rows["C("]["mol"] is None and rows["C("]["parse_error"] and rows[None]["parse_error"]
    assert prepare(df, mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match=PreparationError.__name__):
        prepare(df, mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        prepare(df, mode="OTHER")


def test_text_and_json(spark, tmp_path):
    with gzip.open(tmp_path / "some.txt.gz", "wt") as f:
        f.write("CCO\n\n  \nCCC\n")
    assert [r["smiles"] for r in read_smiles(spark, str(tmp_path / "some.txt.gz")).collect()] == ["CCO", "CCC"]
    with gzip.open(tmp_path / "bits.json.gz", "wt") as f:
        json.dump({"source": {"dataset": "d"}, "molecules": ["CCO", "C#N"], "cases": [{"radius": 2, "fp_size": 2048, "active_bits": [[80, 222, 294, 807, 1057, 1410], [489, 915, 1384]]}]}, f)
    expected = read_expected(spark, str(tmp_path / "bits.json.gz"))
    found = EcfpFingerprint().compute(prepare(expected))
    assert found.count() == 2 and all(r["fp"]["bits"] == r["expected"] for r in found.collect())


def test_guard_and_derived(spark):
    df = spark.createDataFrame([("C",), ("C" * 129,), ("",)], "smiles string")
    assert [r["smiles"] for r in guarded(df).collect()] == ["C"]
    derived = prepare(molecules(spark, "/root/testdata/sf0.001"), mode="FAILFAST")
    assert derived.count() == derived.select("mol_id").distinct().count() > 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("CCO\nC(\n\nC#N\n")
    stream = fingerprinted(smiles_stream(spark, str(tmp_path / "in")), EcfpFingerprint())
    query = write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    rows = {r["smiles"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["C#N"]["fp"]["bits"] == [489, 915, 1384] and rows["C("]["fp"] is None and len(rows) == 3
