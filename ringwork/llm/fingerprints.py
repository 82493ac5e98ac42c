"""Threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document's and two sketches, however unequal, are
samples of the same hashes: the share of one's hashes that the other has estimates containment, and the union of sketches is the sketch of the
union. A text whose hashes are all above the fraction keeps its smallest one, so that no text with words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


WORDS = 5  # words of a shingle; a shorter text is one shingle
SCALE = 8  # one of so many hashes is kept


def sketched(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """df with column out: the sorted array of kept hashes of the text (null: no words); steps of their own keep each hash from being made twice."""
    limit = -(1 << 63) + (1 << 64) // scale
    at = lambda i: [F.get(F.col("__w"), i + k) for k in range(WORDS)]
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    df = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    many = F.transform(F.sequence(F.lit(0), F.size("__w") - WORDS), lambda i: F.xxhash64(*at(i)))
    df = df.withColumn("__h", F.when(F.size("__w") >= WORDS, many).when(F.size("__w") > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__k", F.array_sort(F.array_distinct(F.filter("__h", lambda h: h < limit))))
    return df.withColumn(out, F.when((F.size("__k") > 0) | (F.size("__h") == 0), F.col("__k")).otherwise(F.array(F.array_min("__h")))).drop("__w", "__h", "__k")


def likeness(a: Column, b: Column) -> Column:
    """Share of the union's hashes that both have, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has, 0 to 1; an empty sketch is contained in any."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def merged(sketch: Column, scale: int = SCALE) -> Column:
    """Aggregate: the sketch of the union of a group's texts."""
    limit = -(1 << 63) + (1 << 64) // scale
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketch))))
    kept = F.filter(every, lambda h: h < limit)
    return F.when((F.size(kept) > 0) | (F.size(every) == 0), kept).otherwise(F.slice(every, 1, 1))


def as_text(sketch: Column) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")))


def with_next(rows: DataFrame, key: str, values: dict[str, str], ranges: int | None = None) -> DataFrame:
    """rows with the values of the next row in descending key order (after the last: the first), under the names given.

    Keys are dealt to ranges by their quantiles, so that each task orders a range; the top row of each range (as many rows as ranges: the bound of what the
    driver sees and broadcasts) goes also to the end of the range before it. Equal keys follow the hash of the first value; null keys come last.
    """
    spark = rows.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = next(iter(values))
    cuts = sorted(set(rows.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    dealt = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key).cast("double"))) if cuts else F.lit(0)
    rows = rows.withColumns({"__range": F.when(F.col(key).isNull(), -1).otherwise(dealt), "__tie": F.xxhash64(tie)})
    top = {r["__range"]: r for r in rows.groupBy("__range").agg(F.max(F.struct(F.col(key).alias("k"), F.col("__tie").alias("t"))).alias("m")).collect()}
    order = sorted(top, reverse=True)
    moves = [(top[b]["m"]["k"], top[b]["m"]["t"], a) for a, b in zip(order, [*order[1:], *order[:1]], strict=True)]
    kind = rows.schema[key].dataType.simpleString()
    moved = spark.createDataFrame(moves, f"k {kind}, t long, __to int")
    extra = rows.join(F.broadcast(moved), rows[key].eqNullSafe(moved["k"]) & (rows["__tie"] == moved["t"])).withColumn("__range", F.col("__to")).drop("k", "t", "__to")
    both = rows.withColumn("__extra", F.lit(0)).unionByName(extra.withColumn("__extra", F.lit(1)))
    w = Window.partitionBy("__range").orderBy("__extra", F.col(key).desc_nulls_last(), F.col("__tie").desc())
    return both.withColumns({new: F.lead(old).over(w) for old, new in values.items()}).where("__extra = 0").drop("__range", "__tie", "__extra")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """key, text (null: empty), sketch, edited (text), edited_sketch, next_sketch.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document's, in descending key order, after the last
    the first. A table of one row is its own next; empty tables give no rows; other columns are left aside, whatever they are called; repeated rows follow each other, and rows with
    one key follow the hash of their texts; null keys come last; texts of any length are taken whole. Keys are numbers; others raise TypeError, because their order is dealt by quantiles.
    """
    if not isinstance(docs.schema[key].dataType, NumericType):
        raise TypeError(f"the keys in {key} are no numbers")
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = with_next(sketched(rows, "__text", "__sketch", scale), "__key", {"__text": "__next", "__sketch": "__next_sketch"})
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("__text").substr(F.lit(1), n - half), F.col("__next").substr(F.lit(1), half))
    rows = sketched(rows.withColumn("__edited", edited).drop("__next"), "__edited", "__edited_sketch", scale)
    return rows.select(F.col("__key").alias(key), F.col("__text").alias(text), F.col("__sketch").alias("sketch"), F.col("__edited").alias("edited"), F.col("__edited_sketch").alias("edited_sketch"), F.col("__next_sketch").alias("next_sketch"))
