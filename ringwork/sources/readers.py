"""Sources of molecules: text files of SMILES, JSON files of expected fingerprints, and molecules derived from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fragments of which derived molecules are put together.
FRAGMENTS = ["C", "CC", "N", "O", "C(=O)", "C(=O)N", "c1ccccc1", "C1CCCCC1", "c1ccncc1", "C(F)", "C(Cl)", "S(=O)(=O)", "C#C", "C=C", "P(=O)(O)", "[14CH2]"]
# Atomic numbers and symbols of elements without a type of their own, one or more of each rule for their pi electrons.
METALS = [(25, "Mn"), (43, "Tc"), (75, "Re"), (24, "Cr"), (42, "Mo"), (74, "W"), (90, "Th"), (92, "U"), (93, "Np"), (23, "V"), (41, "Nb"), (73, "Ta"), (26, "Fe"), (44, "Ru"), (76, "Os"), (27, "Co"), (45, "Rh"), (77, "Ir"), (28, "Ni"), (46, "Pd"), (78, "Pt"), (66, "Dy"), (65, "Tb"), (83, "Bi")]
LONGEST = 128  # bytes of a SMILES that the input guard lets through

SOURCE = "source STRUCT<dataset STRING, selection STRING, generator STRING, includeChirality BOOLEAN, useBondTypes BOOLEAN, includeRingMembership BOOLEAN, countSimulation BOOLEAN, minDistance INT, maxDistance INT, use2D BOOLEAN, onlyShortestPaths BOOLEAN, torsionAtomCount INT>"
EXPECTED = {
    "bits": f"{SOURCE}, molecules ARRAY<STRING>, cases ARRAY<STRUCT<radius INT, fp_size INT, active_bits ARRAY<ARRAY<INT>>>>",
    "counts": f"{SOURCE}, molecules ARRAY<STRING>, cases ARRAY<STRUCT<radius INT, fp_size INT, active_counts ARRAY<ARRAY<ARRAY<BIGINT>>>>>",
    "layered": f"{SOURCE}, molecules ARRAY<STRING>, cases ARRAY<STRUCT<radius INT, fp_size INT, layered_active_counts ARRAY<ARRAY<ARRAY<ARRAY<BIGINT>>>>>>",
    "keys": f"{SOURCE}, molecules ARRAY<STRING>, active_bits ARRAY<ARRAY<INT>>",
}


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """smiles of the lines of text files, gzip or not; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("smiles")).where("smiles <> ''")


def read_expected(spark: SparkSession, path: str, kind: str = "bits") -> DataFrame:
    """A JSON file (gzip or not) of molecules and expected fingerprints, a row for each molecule and case: mol_id, smiles, radius, fp_size, expected."""
    whole = spark.read.schema(EXPECTED[kind]).json(path, multiLine=True)
    if kind == "keys":
        return whole.select(F.posexplode(F.arrays_zip("molecules", "active_bits")).alias("mol_id", "x")).select("mol_id", F.col("x.molecules").alias("smiles"), F.col("x.active_bits").alias("expected"))
    name = {"bits": "active_bits", "counts": "active_counts", "layered": "layered_active_counts"}[kind]
    cases = whole.select("molecules", F.explode("cases").alias("c"))
    rows = cases.select("c.radius", "c.fp_size", F.posexplode(F.arrays_zip("molecules", F.col(f"c.{name}").alias("expected"))).alias("mol_id", "x"))
    return rows.select("mol_id", F.col("x.molecules").alias("smiles"), "radius", "fp_size", F.col("x.expected").alias("expected"))


def guarded(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Rows whose SMILES has 1 to LONGEST bytes."""
    return df.where(F.octet_length(smiles).between(1, LONGEST))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id and smiles of molecules derived from the rows of part, by integer arithmetic alone."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    table = F.array(*map(F.lit, FRAGMENTS))

    def fragment(i):
        return F.get(table, ((F.shiftright(key, 4 * i) + size * (2 * i + 1)) % len(FRAGMENTS)).cast("int"))

    core = F.concat(*[F.when(size % 4 >= i, fragment(i)).otherwise("") for i in range(4)])
    end = F.when(size % 10 == 0, ".[Na+]").when(size % 11 == 0, "OCl(=O)=O").otherwise("")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("mol_id"), F.concat(core, end).alias("smiles"))


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id and smiles of single metal atoms with up to four single, double or triple bonds, derived from the rows of part."""
    key = F.col("p_partkey")
    number = (key * 7 + F.col("p_size") * 11) % 256
    ligands = [F.get(F.array(*map(F.lit, ["", "(O)", "(=O)", "(#N)"])), (F.shiftright(number, 2 * j) % 4).cast("int")) for j in range(4)]
    metal = F.get(F.array(*[F.lit(f"[{symbol}]") for _, symbol in METALS]), (key % len(METALS)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("mol_id"), F.concat(metal, *ligands).alias("smiles"))
