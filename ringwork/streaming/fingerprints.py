"""Fingerprints of streams of SMILES. Every operator is a stateless function of one row, so a stream needs no state, watermark or shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringwork.operators.base import Fingerprint
from ringwork.sources.prepare import prepare


def smiles_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the lines of text files in a folder, as column smiles; blank lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.trim("value").alias("smiles")).where("smiles <> ''")


def fingerprinted(stream: DataFrame, fp: Fingerprint, smiles: str = "smiles", out: str = "fp", **prepare_options) -> DataFrame:
    """The stream (or table) with fingerprints of its SMILES; rows that are no SMILES keep their error and have none."""
    return fp.compute(prepare(stream, smiles, **prepare_options), out=out).drop("mol")


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what the stream holds now to Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
