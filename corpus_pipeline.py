"""The corpus pipeline: toxicity, line dedup, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs; all but the last return the
columns of documents. SQL can express neither the classifier nor the packing, so the rows of run() have no oracle; tests/llm holds them against
brute-force versions of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwork.llm import jaccard, packing, spans, suffixes, toxicity
from ringwork.llm.queries import table, tokenizer_path
from ringwork.runtime import ship, written

ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, scores below one half."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = "_".join(["score", *docs.columns])  # no column's name
    return toxicity.scored(docs, model, score=score).where(F.col(f"`{score}`") < 0.5).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that later occurrences of repeated windows cover."""
    return counted(spans.dedup_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, of its smallest doc_id."""
    ship(spark)
    return jaccard.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that also start elsewhere."""
    ship(spark)
    return counted(suffixes.without_repeats(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in sequences of at most 1024."""
    ship(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("near_duplicates", near_stage), ("suffix_dedup", repeats_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
