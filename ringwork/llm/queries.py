"""The registered queries of the operators: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwork.llm import bpe, fingerprints, jaccard, media, packing, spans, suffixes, toxicity, warc
from ringwork.llm.oracles import ORACLES
from ringwork.runtime import ship


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digests=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = spans.dedup_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), report="found")
    return cleaned.select("doc_id", "text", F.col("found.n").alias("n_chars"), "found.n_removed", "found.n_spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = spans.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report="found")
    return cleaned.select("doc_id", "text", F.col("found.n").alias("n_lines"), "found.n_removed", "found.n_spans")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    text = {name: fingerprints.as_text(F.col(column)) for name, column in (("fingerprint", "sketch"), ("edited_fingerprint", "edited_sketch"))}
    near = {f"near_{name}": fingerprints.likeness(F.col("sketch"), F.col(f"{name}_sketch")) for name in ("edited", "next")}
    contained = fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[c.alias(k) for k, c in {**text, **near}.items()], contained)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs, model)
    return rows.select("doc_id", toxicity.fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.media_columns(table(spark, sf_dir, "documents"))
    payload = F.substring("media", media.HEADER + 1, (1 << 31) - 1)
    files = files.withColumn("payload", payload)
    tail = F.expr("substring(payload, -16, 16)")
    return files.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), "media_sha256", "feature", "n_chunks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_media": op6_media,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_suffix_dedup": op10_suffix_dedup,
}

__all__ = ["ORACLES", "QUERIES"]
