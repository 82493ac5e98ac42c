"""Known fingerprints, edge cases, and properties of the fingerprint operators."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ringwork.operators import values
from ringwork.operators.atom_pair import AtomPairFingerprint, with_distances, with_pairs
from ringwork.operators.base import Fingerprint, register
from ringwork.operators.ecfp import CountEcfpFingerprint, EcfpFingerprint, LayeredCountEcfpFingerprint, with_layers
from ringwork.operators.maccs import MaccsFingerprint, atom_keys
from ringwork.operators.torsion import TopologicalTorsionFingerprint
from ringwork.schema import MOL
from ringwork.sources.prepare import explicit_h, prepare

WITH_ID = StructType().add("id", "integer").add("mol", MOL)
MOLECULES = ["CCO", "CC=O", "C#N", "c1ccccc1", "C1CCCCC1", "CC(C)O", "[13CH3][NH3+]", "CCCC", "CCC", "CCCCC", "C1CCC1", "C", "CC.O", "CNO", "C1CC1", "CCCC(C)CCCC", "c1cccc2ccccc12", "c1ccc2[nH]ccc2c1"]

# Known results.
BITS = {
    "CCO": [80, 222, 294, 807, 1057, 1410], "CC=O": [308, 650, 694, 844, 1004, 1057], "C#N": [489, 915, 1384], "c1ccccc1": [389, 1088, 1873], "C1CCCCC1": [2, 926, 1028],
    "CC(C)O": [1, 227, 283, 709, 807, 1057], "[13CH3][NH3+]": [397, 1057, 1082],
}
NO_TYPES = {"CC=O": [650, 694, 844, 1057, 1075, 1655], "C#N": [96, 915, 1384]}
COUNTS = {"CCO": {80: 1, 222: 1, 294: 1, 807: 1, 1057: 1, 1410: 1}, "CCCC": {80: 2, 294: 2, 640: 1, 794: 2, 1057: 2}, "c1ccccc1": {389: 6, 1088: 6, 1873: 6}, "C1CCCCC1": {2: 6, 926: 6, 1028: 6}}
LAYERS = {
    "CCO": [{80: 1, 807: 1, 1057: 1, 1652: 6}, {91: 3, 207: 1, 1008: 1, 1148: 2, 1365: 1, 1839: 1}, {1042: 1, 1056: 1, 1452: 1}],
    "CCCC": [{80: 2, 1057: 2, 1652: 10}, {91: 6, 1148: 4, 1839: 2, 1970: 2}, {202: 2, 898: 2}],
}
PAIRS = {"CCC": [1148, 1404, 1405], "CCCC": [880, 1144, 1145, 1336, 1404, 1405]}
PAIRS_PLAIN = {"CCC": [1311, 1375], "CCCC": [1310, 1358, 1375, 1756]}
KEYS = {"CNO": [24, 68, 69, 71, 93, 94, 102, 124, 131, 139, 151, 158, 160, 161, 164], "CCC": [74, 114, 149, 155, 160]}


@pytest.fixture(scope="module")
def mols(spark):
    return prepare(spark.createDataFrame([(s,) for s in MOLECULES], "smiles string"), mode="FAILFAST").cache()


def bits(fp, df):
    return {r["smiles"]: r["fp"]["bits"] for r in fp.compute(df).collect()}


def as_counts(value):
    return {c["bit"]: c["cnt"] for c in value["counts"]}


def test_ecfp_bits(mols):
    found = bits(EcfpFingerprint(), mols)
    assert {k: found[k] for k in BITS} == BITS
    found = bits(EcfpFingerprint().with_use_bond_types(False), mols)
    assert {k: found[k] for k in NO_TYPES} == NO_TYPES


def test_ecfp_counts(mols):
    found = {r["smiles"]: as_counts(r["fp"]) for r in CountEcfpFingerprint().compute(mols).collect()}
    assert {k: found[k] for k in COUNTS} == COUNTS
    small = {r["smiles"]: as_counts(r["fp"]) for r in CountEcfpFingerprint(0, 64).compute(mols).collect()}
    assert small["CC(C)O"] == {1: 1, 33: 2, 39: 1}


def test_ecfp_layers_with_hydrogens(mols):
    found = {r["smiles"]: [as_counts(x) for x in r["fp"]] for r in LayeredCountEcfpFingerprint().compute(mols.withColumn("mol", explicit_h(F.col("mol")))).collect()}
    assert {k: found[k] for k in LAYERS} == LAYERS


def test_invariant_of_dead_atoms_is_zero(mols):
    assert with_layers(mols, 4).where("smiles = 'CCCC(C)CCCC'").first()["__layers"][4] == [1167252752]


def test_ecfp_properties(mols):
    """Counts have the support of bits, layers add up to counts, the first layer is radius 0, and a larger radius only adds."""
    df = EcfpFingerprint().compute(mols, out="bits")
    df = CountEcfpFingerprint().compute(df, out="counts")
    df = LayeredCountEcfpFingerprint().compute(df, out="layers")
    df = CountEcfpFingerprint(0).compute(df, out="zero")
    df = EcfpFingerprint(1).compute(df, out="fewer")
    for r in df.collect():
        total = {}
        for layer in r["layers"]:
            for k, n in as_counts(layer).items():
                total[k] = total.get(k, 0) + n
        assert len(r["layers"]) == 3 and total == as_counts(r["counts"])
        assert sorted(total) == r["bits"]["bits"] and as_counts(r["layers"][0]) == as_counts(r["zero"])
        assert set(r["fewer"]["bits"]) <= set(r["bits"]["bits"]) and all(0 <= b < 2048 for b in total)


def test_atom_pairs(mols):
    found, plain = bits(AtomPairFingerprint(), mols), bits(AtomPairFingerprint().with_count_simulation(False), mols)
    assert {k: found[k] for k in PAIRS} == PAIRS and {k: plain[k] for k in PAIRS_PLAIN} == PAIRS_PLAIN
    assert found["C"] == [] and bits(AtomPairFingerprint(3), mols)["CCC"] == [] and bits(AtomPairFingerprint(0), mols)["CCC"] == []
    assert all(b < 10 for x in bits(AtomPairFingerprint(10, count_simulation=False), mols).values() for b in x)
    assert bits(AtomPairFingerprint(max_distance=255), mols) == bits(AtomPairFingerprint(max_distance=254), mols)
    with pytest.raises(ValueError):
        AtomPairFingerprint(max_distance=256)


def test_fingerprints_can_be_filtered(mols):
    """A filter, a join and an explode on a fingerprint are planned behind its projections: the plan stays as long as without them."""
    for fp in (EcfpFingerprint(radius=5), AtomPairFingerprint(), TopologicalTorsionFingerprint()):
        df = fp.compute(mols).select("smiles", "fp")
        length = lambda q: len(q._jdf.queryExecution().optimizedPlan().toString())
        plain = length(df)
        kept = df.where(F.size("fp.bits") >= 4)
        assert length(kept) < 1.5 * plain and length(df.select("smiles", F.explode("fp.bits"))) < 1.5 * plain
        assert length(df.join(df.select("fp", F.col("smiles").alias("other")), "fp")) < 3 * plain
        want = {r["smiles"] for r in df.collect() if r["fp"] and len(r["fp"]["bits"]) >= 4}
        assert {r["smiles"] for r in kept.collect()} == want and want


def test_pairs_of_a_path(spark):
    chain = prepare(spark.createDataFrame([("CCCC",)], "smiles string"))
    from ringwork.functions.invariants import with_adjacency

    dist = with_distances(with_adjacency(chain), 30)
    pairs = lambda a, b: [tuple(p) for p in with_pairs(dist, a, b).first()["__pairs"]]
    assert sorted(pairs(1, 2)) == [(0, 1, 1), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1)] and sorted(pairs(2, 2)) == [(0, 2, 2), (1, 3, 2)]


def test_torsions(mols):
    found, plain = bits(TopologicalTorsionFingerprint(), mols), bits(TopologicalTorsionFingerprint(count_simulation=False), mols)
    assert (found["CCCCC"], found["C1CCC1"], plain["CCCCC"], plain["C1CCC1"]) == ([0, 1], [284, 285, 286], [0], [71])
    short = bits(TopologicalTorsionFingerprint().with_only_shortest_paths(True), mols)
    assert short["C1CCC1"] == [] and all(set(short[k]) <= set(found[k]) for k in found)
    assert plain["C1CC1"] != []  # a walk around three atoms closes
    assert bits(TopologicalTorsionFingerprint(torsion_atom_count=1), mols)["CCCCC"] == []
    with pytest.raises(ValueError):
        TopologicalTorsionFingerprint(torsion_atom_count=8)


def test_keys(mols):
    df = MaccsFingerprint().compute(mols).withColumn("some", atom_keys(F.col("mol")))
    rows = {r["smiles"]: r for r in df.collect()}
    assert {k: rows[k]["fp"]["bits"] for k in KEYS} == KEYS and rows["CCC"]["fp"]["len"] == 167
    assert 125 in rows["c1cccc2ccccc12"]["fp"]["bits"] and 125 not in rows["c1ccccc1"]["fp"]["bits"] and 166 in rows["CC.O"]["fp"]["bits"]
    for r in rows.values():
        assert set(r["some"]) <= set(r["fp"]["bits"])


def test_molecules_without_atoms_or_at_all(spark):
    df = spark.createDataFrame([(1, ([], [], [])), (2, None)], WITH_ID)
    for fp in (EcfpFingerprint(), AtomPairFingerprint(), TopologicalTorsionFingerprint(), MaccsFingerprint()):
        assert isinstance(fp, Fingerprint)
        rows = {r["id"]: r["fp"] for r in fp.compute(df).collect()}
        assert rows[1]["bits"] == [] and rows[2] is None
    layers = {r["id"]: r["fp"] for r in LayeredCountEcfpFingerprint().compute(df).collect()}
    assert len(layers[1]) == 3 and layers[2] is None
    assert EcfpFingerprint(2, 0).compute(df).where("id = 1").first()["fp"]["len"] == 0


def test_bad_bonds_are_left_out(spark):
    atom = (6, 0, None, False, 0, 3, False, 0, 0)
    good, bad = [(0, 1, "single", False)], [(0, 1, "single", False), (1, 7, "double", False), (1, 1, "single", False), (1, 0, "double", False)]
    df = spark.createDataFrame([(1, ([atom, atom], good, [])), (2, ([atom, atom], bad, []))], WITH_ID)
    for fp in (EcfpFingerprint(), AtomPairFingerprint(), TopologicalTorsionFingerprint(torsion_atom_count=2)):
        a, b = (r["fp"] for r in fp.compute(df).orderBy("id").collect())
        assert a == b


def test_own_invariants_and_codes(spark, mols):
    df = mols.withColumn("ones", F.transform("mol.atoms", lambda a: F.lit(1).cast("bigint"))).withColumn("twos", F.transform("mol.bonds", lambda b: F.lit(2).cast("bigint")))
    rows = EcfpFingerprint(0, atom_invariants="ones", bond_invariants="twos").compute(df).collect()
    assert all(r["fp"]["bits"] == [1] for r in rows)
    assert AtomPairFingerprint(atom_codes="ones").compute(df).where("smiles = 'CCC'").first()["fp"]["bits"]
    assert TopologicalTorsionFingerprint(end_codes="ones", inner_codes="ones").compute(df).where("smiles = 'CCCCC'").first()["fp"]["bits"]


def test_values(spark):
    one = spark.range(1)
    fp, cf = values.from_bits(F.array(*map(F.lit, [False, True, False, True]))), values.from_counts(F.array(*map(F.lit, [0, 2, 0, 5])))
    r = one.select(
        fp.alias("fp"), values.contains(fp, 3).alias("in"), values.contains(fp, 9).alias("out"), values.set_bit(fp, 0).alias("more"), values.set_bit(fp, 4).alias("same"), values.as_bitslice(fp).alias("flags"),
        values.count(cf, 3).alias("five"), values.count(cf, 8).alias("none"), values.increment(cf, 0).alias("up"), values.as_slice(cf).alias("dense"), values.is_empty(values.zeros(0)).alias("empty"),
        values.formula(values.layered_zeros(0, 4)).alias("formula"), values.layer(values.layered_zeros(2, 4), 1).alias("layer"), values.increment_layer(values.layered_zeros(2, 4), 1, 3).alias("raised"),
        values.count(values.increment(values.from_counts(F.array(F.lit(0xFFFFFFFF))), 0), 0).alias("full"),
    ).first()
    assert r["fp"]["bits"] == [1, 3] and r["in"] and not r["out"] and r["more"]["bits"] == [0, 1, 3] and r["same"] == r["fp"] and r["flags"] == [False, True, False, True]
    assert (r["five"], r["none"], r["dense"], r["empty"], r["formula"], r["layer"]["len"], r["full"]) == (5, 0, [0, 2, 0, 5], True, None, 4, 0xFFFFFFFF)
    assert as_counts(r["up"]) == {0: 1, 1: 2, 3: 5} and as_counts(r["raised"][1]) == {3: 1} and as_counts(r["raised"][0]) == {}


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT maccs_keys('CCC') AS keys, size(mol_from_smiles('CCO').atoms) AS n, maccs_keys('C(') AS none").first()
    assert r["keys"] == KEYS["CCC"] and r["n"] == 3 and r["none"] is None
