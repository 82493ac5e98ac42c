"""The registered queries: each operator over the molecules derived from the part table, as long rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwork.functions.invariants import with_adjacency, with_atom_codes, with_atom_invariants, with_bond_invariants, with_centers, with_pi_electrons
from ringwork.operators import graph, values
from ringwork.operators.atom_pair import AtomPairFingerprint, with_distances, with_pairs
from ringwork.operators.ecfp import CountEcfpFingerprint, EcfpFingerprint, LayeredCountEcfpFingerprint
from ringwork.operators.maccs import MaccsFingerprint, aromatic_ring_count, atom_keys, fragment_count
from ringwork.operators.torsion import TopologicalTorsionFingerprint, with_paths
from ringwork.schema import BITS
from ringwork.sources.prepare import explicit_h, once_each, prepare, try_prepare
from ringwork.sources.readers import complexes, guarded, molecules

Query = Callable[[SparkSession, str], DataFrame]
#: Keys of two and three atoms in a row that the oracle can join for.
PATH_KEYS = (14, 17, 24, 31, 33, 40, 41, 52, 60, 63, 67, 71, 77, 78, 94, 99, 102, 110, 117, 123, 124, 154, 157, 158)
ATOM_KEYS = (20, 27, 29, 35, 42, 44, 46, 49, 57, 84, 88, 103, 121, 131, 134, 139, 140, 141, 142, 146, 149, 151, 159, 160, 161, 162, 164, 165)


def same(df: DataFrame) -> DataFrame:
    return df


def prepared(spark: SparkSession, sf_dir: str, work: Callable[[DataFrame], DataFrame], *columns: Column | str, normalized: bool = True) -> DataFrame:
    """mol_id and the columns of what work makes of the molecules, raw ones unguarded; molecules of equal SMILES are read and worked on once."""
    rows = molecules(spark, sf_dir)
    made = once_each(rows if not normalized else guarded(rows), lambda texts: work(prepare(texts, mode="DROPMALFORMED", normalized=normalized)).select("smiles", *columns))
    return made.drop("smiles")


def exploded(df: DataFrame, array: Column | str, name: str, place: str | None = None) -> DataFrame:
    """mol_id and the elements of an array (with their places).

    An outer explode whose nulls are filtered behind it: of a plain one the optimizer infers a filter that it pushes down through every projection. That does
    not matter for fingerprints, which are settled, but for what they are made of.
    """
    if place:
        return df.select("mol_id", F.posexplode_outer(array).alias(place, name)).where(F.col(place).isNotNull())
    return df.select("mol_id", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def exploded_bits(df: DataFrame, fp: str = "fp") -> DataFrame:
    return exploded(df, f"{fp}.bits", "bit")


def exploded_counts(df: DataFrame, fp: str = "fp") -> DataFrame:
    return exploded(df, f"{fp}.counts", "c").select("mol_id", "c.bit", "c.cnt")


def by_atom(df: DataFrame, column: Column | str, name: str) -> DataFrame:
    return exploded(df, column, name, "atom")


def ecfp(**config) -> Query:
    return lambda spark, sf_dir: exploded_bits(prepared(spark, sf_dir, EcfpFingerprint(**config).compute, "fp"))


def ecfp_count(**config) -> Query:
    return lambda spark, sf_dir: exploded_counts(prepared(spark, sf_dir, CountEcfpFingerprint(**config).compute, "fp"))


def ecfp_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = exploded(prepared(spark, sf_dir, LayeredCountEcfpFingerprint().compute, "fp"), "fp", "f", "layer")
    counts = layers.select("mol_id", "layer", F.explode_outer("f.counts").alias("c")).where("c is not null")
    return counts.select("mol_id", "layer", "c.bit", "c.cnt")


def pairs(**config) -> Query:
    return lambda spark, sf_dir: exploded_bits(prepared(spark, sf_dir, AtomPairFingerprint(**config).compute, "fp"))


def torsions(**config) -> Query:
    return lambda spark, sf_dir: exploded_bits(prepared(spark, sf_dir, TopologicalTorsionFingerprint(**config).compute, "fp"))


def mol_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules(spark, sf_dir)


def mol_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = by_atom(prepared(spark, sf_dir, same, "mol.atoms"), "atoms", "a")
    return atoms.select("mol_id", "atom", "a.z", "a.charge", "a.aromatic", (F.col("a.h_explicit") + F.col("a.h_implicit")).alias("h"), "a.in_ring", "a.comp", "a.delta_mass")


def mol_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(prepared(spark, sf_dir, same, "mol.bonds"), "bonds", "b").select("mol_id", "b.a", "b.b", "b.kind", "b.in_ring")


def mol_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir, with_adjacency, "__adj")
    return by_atom(df, "__adj", "bonds").select("mol_id", "atom", F.size("bonds").alias("degree"), F.aggregate("bonds", F.lit(0), lambda n, b: n + b["order"]).alias("orders"))


def mol_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, same, F.size("mol.atoms").alias("n_atoms"), F.size("mol.bonds").alias("n_bonds"), F.size("mol.rings").alias("n_rings"), fragment_count(F.col("mol")).alias("n_fragments"))


def atom_invariant(ring: bool) -> Query:
    work = lambda df: with_atom_invariants(with_centers(with_adjacency(df)), include_ring_membership=ring)
    return lambda spark, sf_dir: by_atom(prepared(spark, sf_dir, work, "__inv"), "__inv", "inv")


def bond_invariant(types: bool) -> Query:
    work = lambda df: with_bond_invariants(with_centers(with_adjacency(df)), use_bond_types=types)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prepared(spark, sf_dir, work, F.arrays_zip(F.col("mol.bonds"), F.col("__binv").alias("inv")).alias("zipped"))
        return exploded(df, "zipped", "x").select("mol_id", "x.bonds.a", "x.bonds.b", "x.inv")

    return query


def atom_pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = lambda df: with_atom_codes(with_pi_electrons(with_centers(with_adjacency(df))))
    df = prepared(spark, sf_dir, work, F.arrays_zip(F.col("__pi").alias("pi"), F.col("__codes").alias("code")).alias("zipped"))
    return by_atom(df, "zipped", "x").select("mol_id", "atom", "x.pi", "x.code")


def torsion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(df: DataFrame) -> DataFrame:
        df = with_pi_electrons(with_centers(with_adjacency(df)))
        return with_atom_codes(with_atom_codes(df, subtract=1, out="__end"), subtract=2, out="__inner")

    df = prepared(spark, sf_dir, work, F.arrays_zip(F.col("__end").alias("end_code"), F.col("__inner").alias("inner_code")).alias("zipped"))
    return by_atom(df, "zipped", "x").select("mol_id", "atom", "x.end_code", "x.inner_code")


def atom_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir, lambda df: with_pairs(with_distances(with_adjacency(df), 30)), "__pairs")
    return exploded(df, "__pairs", "p").select("mol_id", "p.a", "p.b", "p.d")


def torsion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir, lambda df: with_paths(with_adjacency(df)), "__paths")
    return exploded(df, "__paths", "p").select("mol_id", *[F.get("p", F.lit(k)).alias(f"a{k}") for k in range(4)])


def keys_among(keys: tuple[int, ...]) -> Query:
    return lambda spark, sf_dir: maccs_full(spark, sf_dir).where(F.col("bit").isin(*keys))


def mol_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = F.col("mol")
    at_second = graph.bonds(mol, 1)
    return prepared(
        spark, sf_dir, graph.with_neighbours,
        graph.atom_count(mol).alias("n_atoms"),
        graph.is_empty_molecule(mol).alias("empty"),
        graph.has_edges(mol).alias("has_edges"),
        graph.edge_entries(mol).alias("n_entries"),
        graph.atom(mol, 0)["z"].alias("first_z"),
        graph.atom(mol, 999)["z"].alias("outside_z"),
        F.size(at_second).alias("n_at_second"),
        F.aggregate(at_second, F.lit(0), lambda n, b: n + graph.other_node(b, 1)).alias("sum_at_second"),
        F.aggregate("neighbours", F.lit(0), lambda n, x: n + F.size(x)).alias("n_neighbours"),
    )


def mol_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.directed_table(prepared(spark, sf_dir, same, "mol")).drop("edge")


def maccs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_bits(prepared(spark, sf_dir, MaccsFingerprint().compute, "fp"))


def maccs_single_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = exploded(prepared(spark, sf_dir, same, atom_keys(F.col("mol")).alias("keys")), "keys", "bit")
    return keys.where(F.col("bit").isin(*ATOM_KEYS))


def maccs_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, same, aromatic_ring_count(F.col("mol")).alias("aromatic_rings"), fragment_count(F.col("mol")).alias("fragments"))


def fp_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp, counts = F.col("fp"), F.col("counts")
    return prepared(
        spark, sf_dir, lambda df: CountEcfpFingerprint().compute(EcfpFingerprint().compute(df), out="counts"),
        values.length(fp).alias("length"),
        values.contains(fp, 1057).alias("has_1057"),
        values.contains(fp, 999_999).alias("has_outside"),
        values.is_empty(fp).alias("no_length"),
        F.size(values.active_bits(fp)).alias("n_bits"),
        values.count(counts, 1057).alias("count_1057"),
        values.count(counts, -1).alias("count_outside"),
        F.aggregate(values.as_slice(counts), F.lit(0).cast("bigint"), lambda n, x: n + x).alias("n_counts"),
        F.size(values.active_bits(values.set_bit(fp, 5000))).alias("n_after_outside"),
    )


def fp_layer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row for each layer that emits, not for each of its bits, is what the rollup repeats for its levels
    total = lambda f: F.when(F.size(f["counts"]) > 0, F.aggregate(f["counts"], F.lit(0).cast("bigint"), lambda n, c: n + c["cnt"]))
    layers = prepared(spark, sf_dir, LayeredCountEcfpFingerprint().compute, F.transform("fp", total).alias("totals"))
    return exploded(layers, "totals", "cnt", "layer").where("cnt is not null").rollup("mol_id", "layer").agg(F.sum("cnt").alias("cnt"))


def with_hydrogens(df: DataFrame) -> DataFrame:
    return df.withColumn("mol", explicit_h(F.col("mol")))


def explicit_h_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_counts(prepared(spark, sf_dir, lambda df: CountEcfpFingerprint().compute(with_hydrogens(df)), "fp"))


def explicit_h_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hydrogens = F.size(F.filter("mol.atoms", lambda a: a["z"] == 1))
    return prepared(spark, sf_dir, with_hydrogens, F.size("mol.atoms").alias("n_atoms"), F.size("mol.bonds").alias("n_bonds"), hydrogens.alias("n_hydrogens"))


def atom_pair_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_bits(prepared(spark, sf_dir, AtomPairFingerprint().compute, "fp", normalized=False))


def torsion_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_bits(prepared(spark, sf_dir, TopologicalTorsionFingerprint().compute, "fp", normalized=False))


def pi_electrons_metals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(texts: DataFrame) -> DataFrame:
        df = with_atom_codes(with_pi_electrons(with_centers(with_adjacency(prepare(texts, mode="FAILFAST")))))
        return df.select("smiles", F.get("mol.atoms", F.lit(0))["z"].alias("z"), F.size(F.get("__adj", F.lit(0))).alias("degree"), F.get("__pi", F.lit(0)).alias("pi"), F.get("__codes", F.lit(0)).alias("code"))

    return once_each(complexes(spark, sf_dir), work).drop("smiles")


def fp_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir, EcfpFingerprint(radius=3).compute, "fp")
    return df.where((F.size("fp.bits") >= 12) & F.array_contains("fp.bits", 1057)).select("mol_id", F.size("fp.bits").alias("n_bits"))


def smiles_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = molecules(spark, sf_dir).withColumn("smiles", F.expr("repeat(smiles, cast(1 + mol_id % 9 AS int))"))
    return guarded(df).select("mol_id", F.octet_length("smiles").alias("n_bytes"))


def smiles_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.get(F.array(*map(F.lit, ["", "(", "[Xx]", "1"])), (F.col("mol_id") % 4).cast("int"))
    rows = molecules(spark, sf_dir).withColumn("smiles", F.concat("smiles", end))
    work = lambda texts: try_prepare(texts).select("smiles", F.col("mol").isNotNull().alias("prepared"), (F.length("parse_error") > 0).alias("has_error"))
    return once_each(rows, work).drop("smiles")


def ecfp_zero_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, EcfpFingerprint(fp_size=0).compute, values.length(F.col("fp")).alias("length"), F.size(values.active_bits(F.col("fp"))).alias("n_bits"))


def with_numbers(df: DataFrame, mol: str = "mol") -> DataFrame:
    return df.withColumn("numbers", F.transform(F.col(f"{mol}.atoms"), lambda a: a["z"].cast("bigint")))


class ElementFingerprint:
    """An algorithm that is not built in: a bit for each element."""

    def compute(self, df: DataFrame, mol: str = "mol", out: str = "fp") -> DataFrame:
        bits = F.array_sort(F.array_distinct(F.transform(F.col(f"{mol}.atoms"), lambda a: a["z"])))
        return df.withColumn(out, F.struct(F.lit(128).alias("len"), bits.alias("bits")).cast(BITS))


def custom_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_bits(prepared(spark, sf_dir, ElementFingerprint().compute, "fp"))


def custom_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_bits(prepared(spark, sf_dir, lambda df: EcfpFingerprint(radius=0, atom_invariants="numbers").compute(with_numbers(df)), "fp"))


def custom_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded_bits(prepared(spark, sf_dir, lambda df: AtomPairFingerprint(count_simulation=False, atom_codes="numbers").compute(with_numbers(df)), "fp"))


QUERIES: dict[str, Query] = {
    "mol_smiles": mol_smiles,
    "mol_atoms": mol_atoms,
    "mol_bonds": mol_bonds,
    "mol_degree": mol_degree,
    "mol_components": mol_components,
    "mol_accessors": mol_accessors,
    "mol_directed": mol_directed,
    "hash_atom_invariant": atom_invariant(True),
    "hash_atom_invariant_no_ring": atom_invariant(False),
    "bond_invariant": bond_invariant(True),
    "bond_invariant_no_types": bond_invariant(False),
    **{f"ecfp_bits_r{r}_n{n}": ecfp(radius=r, fp_size=n) for r in range(4) for n in (64, 2048)},
    "ecfp_bits_no_bond_types": ecfp(use_bond_types=False),
    "ecfp_bits_no_ring": ecfp(include_ring_membership=False),
    "ecfp_count_r2": ecfp_count(),
    "ecfp_count_n1000": ecfp_count(fp_size=1000),
    "ecfp_layered_r2": ecfp_layered,
    "atom_pair_codes": atom_pair_codes,
    "atom_pair_distances": atom_pair_distances,
    "atom_pair_bits": pairs(),
    "atom_pair_bits_nosim": pairs(count_simulation=False),
    "atom_pair_bits_dist_2_5": pairs(min_distance=2, max_distance=5),
    "atom_pair_bits_raw": atom_pair_raw,
    "torsion_codes": torsion_codes,
    "torsion_paths": torsion_paths,
    "torsion_bits": torsions(),
    "torsion_bits_nosim": torsions(count_simulation=False),
    "torsion_bits_shortest": torsions(only_shortest_paths=True),
    "torsion_bits_k5": torsions(torsion_atom_count=5),
    "torsion_bits_raw": torsion_raw,
    "maccs_single_atom": maccs_single_atom,
    "maccs_single_atom_patterns": keys_among(ATOM_KEYS),
    "maccs_special": maccs_special,
    "maccs_paths": keys_among(PATH_KEYS),
    "maccs_full": maccs_full,
    "fp_accessors": fp_accessors,
    "fp_layer_rollup": fp_layer_rollup,
    "explicit_h_atoms": explicit_h_atoms,
    "explicit_h_counts": explicit_h_counts,
    "pi_electrons_metals": pi_electrons_metals,
    "fp_filtered": fp_filtered,
    "smiles_guarded": smiles_guarded,
    "smiles_errors": smiles_errors,
    "ecfp_zero_size": ecfp_zero_size,
    "custom_algorithm": custom_algorithm,
    "custom_invariants": custom_invariants,
    "custom_codes": custom_codes,
}
