"""Schemas of molecules and fingerprints."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

ATOM = StructType(
    [
        StructField("z", IntegerType()),  # 0: wildcard
        StructField("charge", IntegerType()),
        StructField("isotope", IntegerType()),
        StructField("aromatic", BooleanType()),
        StructField("h_explicit", IntegerType()),  # written in brackets
        StructField("h_implicit", IntegerType()),
        StructField("in_ring", BooleanType()),
        StructField("comp", IntegerType()),
        StructField("delta_mass", IntegerType()),
    ]
)
BOND = StructType([StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("kind", StringType()), StructField("in_ring", BooleanType())])
MOL = StructType([StructField("atoms", ArrayType(ATOM)), StructField("bonds", ArrayType(BOND)), StructField("rings", ArrayType(ArrayType(IntegerType())))])
BITS = StructType([StructField("len", IntegerType()), StructField("bits", ArrayType(IntegerType()))])
COUNTS = StructType([StructField("len", IntegerType()), StructField("counts", ArrayType(StructType([StructField("bit", IntegerType()), StructField("cnt", LongType())])))])
KINDS = ("single", "up", "down", "double", "triple", "quadruple", "aromatic")
