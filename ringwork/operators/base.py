"""What a fingerprint is to the rest of the engine, and the functions that SQL can call."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType

from ringwork.operators.maccs import keys_of
from ringwork.runtime import ship
from ringwork.schema import MOL
from ringwork.sources.prepare import as_molecule, read_molecule


@runtime_checkable
class Fingerprint(Protocol):
    """An algorithm over molecules: implement compute() and use it like the built-in ones, with df.transform(fp.compute)."""

    def compute(self, df: DataFrame, mol: str = "mol", out: str = "fp") -> DataFrame: ...


def register(spark: SparkSession) -> None:
    """Make mol_from_smiles(smiles) and maccs_keys(smiles) callable from SQL; both are null for what is no SMILES."""
    ship(spark)
    kind = to_arrow_type(MOL)

    def mol_from_smiles(smiles: pa.Array) -> pa.Array:
        return pa.array([read_molecule(s)[0] for s in smiles.to_pylist()], kind)

    def maccs_keys(smiles: pa.Array) -> pa.Array:
        mols = [read_molecule(s)[0] for s in smiles.to_pylist()]
        return pa.array([None if m is None else keys_of(as_molecule(m)) for m in mols], pa.list_(pa.int32()))

    spark.udf.register("mol_from_smiles", F.arrow_udf(mol_from_smiles, MOL))
    spark.udf.register("maccs_keys", F.arrow_udf(maccs_keys, ArrayType(IntegerType())))
