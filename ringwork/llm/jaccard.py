"""Similarity join of word-shingle sets by chosen paths.

A set is represented by COORDINATES minimum hashes; two sets agree in each with the probability of their Jaccard similarity. A run puts sets that agree in the run's coordinate
into one bucket. A bucket of at most BUCKET sets is compared by brute force; a larger one is split again, each set going on along BRANCHES coordinates
sampled for that bucket, and so on for LEVELS levels; a part that keeps at least half of a large bucket is not split further, since its sets are alike. Runs are repeated until the chance that a pair at the threshold met in none is below 1 - RECALL. What is found
are candidates; they are joined to groups, and within a group all sets are compared exactly, in blocks, without listing pairs.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwork.llm.graph import components
from ringwork.llm.suffixes import joined, keyed, packed
from ringwork.runtime import numbered, place, written

WORDS = 5  # of a shingle; a shorter text is one shingle
THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 64
BUCKET = 256
BRANCHES = 2
LEVELS = 3
MARGIN = 0.25  # candidates agree in a share of coordinates down to so much below the threshold (five standard errors)
BLOCK = 250  # sets of a block in the exact comparison
DENSE = 48  # shingles in at least so many sets of a block are multiplied as a matrix
CACHED = 100_000  # words remembered during a task
WORD = re.compile(r"\w+")
FACTORS = np.random.RandomState(11).randint(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = np.random.RandomState(12).randint(0, 1 << 62, COORDINATES, dtype=np.uint64)


def unlike(threshold: float) -> float:
    """Probability that a pair at the threshold agrees in too few coordinates for a candidate, which is the same in all runs."""
    least = math.ceil((threshold - MARGIN) * COORDINATES)
    return sum(math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(least))


def runs_for(threshold: float, recall: float, branches: int = BRANCHES, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met and is a candidate with the probability `recall`, whatever levels its buckets go through."""
    met = threshold * (1 - (1 - threshold) ** branches) ** levels
    return max(1, math.ceil(math.log(1 - recall - unlike(threshold)) / math.log(1 - met)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` lowered words; of all words if there are fewer; empty without words."""
    import xxhash

    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.empty(0, np.uint64)
    held = sys.modules[__name__].__dict__.setdefault("_words", {})
    if len(held) > CACHED:
        held.clear()
    for w in set(found).difference(held):
        held[w] = xxhash.xxh3_64_intdigest(w.encode())
    h = np.fromiter(map(held.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def forget() -> None:
    """Give back the memory of the words of a task."""
    sys.modules[__name__].__dict__.pop("_words", None)


def sketch(found: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set, 32 bits each."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, ((found[at : at + 4096] * FACTORS[:, None] + SHIFTS[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32).view(np.int32)


def sets(rows: DataFrame) -> DataFrame:
    """__id, __hash, set (hash of the shingle set; null: no words), sketch of rows of keyed()."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                names, sketches = [], []
                for data in b.column(2).to_pylist():
                    found = shingles(data.decode())
                    names.append(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64).item() if len(found) else None)
                    sketches.append(sketch(found) if len(found) else np.empty(0, np.int32))
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketches)], dtype=np.int32)), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.int64()), flat], names=["__id", "__hash", "set", "sketch"])
        forget()

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, __hash long, set long, sketch array<int>")


def roots(near: np.ndarray) -> np.ndarray:
    """The first member of each member's component in a matrix of neighbours."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        lower = np.where(near, label[None, :], n).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def grouped(df: DataFrame, key: str, solve, schema: str) -> DataFrame:
    """solve(list of rows of one key) -> list of rows, over rows brought together by key; a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = [x.split()[0] for x in schema.split(",")]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                for row in whole.slice(at, 500).to_pylist():
                    if held and row[key] != held[0][key]:
                        out += solve(held)
                        held = []
                    held.append(row)
                if len(out) > 10_000:
                    yield made()
        if held:
            out += solve(held)
        if out:
            yield made()
        forget()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def bucket_edges(rows: list[dict]) -> list[tuple[int, int]]:
    """(set, first set of its component) among the sets of a bucket whose sketches are alike enough to be candidates."""
    if len(rows) < 2:
        return []
    names = sorted({(r["set"], tuple(r["sketch"])) for r in rows})
    x = np.array([s for _, s in names], np.int32)
    alike = np.zeros((len(x), len(x)), np.uint8)
    for k in range(COORDINATES):
        alike += x[:, k, None] == x[None, :, k]
    root = roots(alike >= (THRESHOLD - MARGIN) * COORDINATES)
    return [(names[i][0], names[r][0]) for i, r in enumerate(root.tolist()) if i != r]


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that may be alike; reps: set, sketch (written)."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(runs_for(THRESHOLD, RECALL) - 1))).alias("r")
    paths = reps.select("set", "sketch", runs).select("set", F.xxhash64("r", F.get("sketch", F.col("r"))).alias("p"), F.lit(1 << 60).alias("of"))
    edges = None
    for level in range(LEVELS + 1):
        sizes = paths.groupBy("p").agg(F.count("*").alias("n"), F.min("set").alias("first"), F.max("of").alias("of")).where("n > 1")
        met = written(paths.drop("of").join(written(sizes, "bucket-sizes"), "p"), "buckets")
        small = met.where(F.col("n") <= BUCKET).join(reps, "set").select("p", "set", "sketch")
        found = grouped(small, "p", bucket_edges, "a long, b long")
        large = met.where(F.col("n") > BUCKET)
        # all sets of such a bucket agree along the whole path, or with most of the bucket before: candidates as they are
        dense = F.lit(level == LEVELS) | (F.col("n") * 2 >= F.col("of"))
        found = found.unionByName(large.where(dense & (F.col("set") != F.col("first"))).select(F.col("set").alias("a"), F.col("first").alias("b")))
        edges = written(found if edges is None else edges.unionByName(found).distinct(), "candidates")
        large = large.where(~dense)
        if large.isEmpty():
            return edges
        onward = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("j")
        coordinate = F.get("sketch", F.pmod(F.xxhash64("p", "j", F.lit(level)), F.lit(COORDINATES)).cast("int"))
        paths = large.join(reps, "set").select("set", "sketch", "p", "n", onward).select("set", F.xxhash64("p", "j", coordinate).alias("p"), F.col("n").alias("of"))
    return edges


def common(sets_: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each two sets."""
    m = len(sets_)
    row = np.repeat(np.arange(m), [len(s) for s in sets_])
    _, place, counts = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    order = np.argsort(place, kind="stable")
    row, start = row[order], np.concatenate([[0], np.cumsum(counts)[:-1]])
    for c in np.unique(counts[(counts > 1) & (counts < DENSE)]):  # shingles in few sets: their pairs
        which = start[counts == c]
        for at in range(0, len(which), max(1, 2_000_000 // int(c * c))):
            members = row[which[at : at + max(1, 2_000_000 // int(c * c)), None] + np.arange(c)]
            np.add.at(out.reshape(-1), (members[:, :, None] * m + members[:, None, :]).reshape(-1), 1)
    many = np.flatnonzero(counts >= DENSE)
    for at in range(0, len(many), 2048):  # shingles in many sets: a matrix product
        some = many[at : at + 2048]
        x = np.zeros((m, len(some)), np.float32)
        for k, p in enumerate(some.tolist()):
            x[row[start[p] : start[p] + counts[p]], k] = 1
        out += x @ x.T
    return out


def exact_links(rows: list[dict]) -> list[tuple[int, int, int]]:
    """(set, documents it is linked to, first set of its component) among the sets of a pair of blocks, exactly."""
    import zstandard as zstd

    press = zstd.ZstdDecompressor()
    found = [shingles(press.decompress(r["__z"]).decode()) for r in rows]
    sizes = np.array([len(f) for f in found], np.float32)
    both = common(found)
    near = both >= np.float32(THRESHOLD - 1e-9) * (sizes[:, None] + sizes[None, :] - both)
    side = np.array([r["side"] for r in rows])
    if (side > 0).any():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    links = near.astype(np.float64) @ np.array([r["n"] for r in rows], np.float64)
    order = np.argsort([r["set"] for r in rows])
    root = np.empty(len(rows), np.int64)
    root[order] = order[roots(near[np.ix_(order, order)])]
    return [(rows[i]["set"], int(links[i]), rows[int(root[i])]["set"]) for i in np.flatnonzero(links > 0).tolist()]


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, __hash, class (hash; null: no words), class_id (the smallest key of its class) and n_links (documents at least THRESHOLD like it) of each row of docs.

    Classes are the components of the links; different ones may have the same smallest key, where keys tie. Documents with equal sets of shingles are linked as copies. A document without words (null or empty text) is a class of its own
    without links; if its key is null so is class_id. Rows of equal key and equal text count as copies. Null keys come last in a class. Other columns are left
    aside; an empty table gives no rows.
    """
    rows = keyed(docs, key, text)
    found = written(sets(rows), "sets")
    one = [F.first(c).alias(c) for c in ("sketch", "__id", "__hash")]
    reps = written(found.where("set is not null").groupBy("set").agg(F.count("*").alias("n"), F.min("__id").alias("least"), *one), "set-reps")
    groups = components(candidates(reps.select("set", "sketch"))).select(F.col("node").alias("set"), "label")
    sizes = groups.groupBy("label").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = groups.join(written(sizes, "group-sizes"), "label").join(reps.select("set", "n", "__id", "__hash"), "set")
    members = members.select("set", "n", "__id", "__hash", "label", blocks.alias("of"), F.pmod(F.xxhash64("set"), blocks.cast("long")).cast("int").alias("block"))
    texts = joined(packed(rows), members, "inner")
    # each block meets itself and every other block of its group; side tells two blocks apart
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
    pairs = texts.dropDuplicates(["set"]).select("set", "n", "__z", "label", "block", other)
    pairs = pairs.select("set", "n", "__z", F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    exact = written(grouped(pairs, "pair", exact_links, "set long, links long, root long"), "links")
    parts = components(exact.select(F.col("set").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("set").agg(F.sum("links").alias("links"))
    known = reps.select("set", "n", "least").join(links, "set", "left").join(parts.withColumnRenamed("node", "set"), "set", "left").where("n > 1 or links > 0")
    known = written(known.select("set", F.coalesce("label", "set").alias("label"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "known")
    least = written(known.groupBy("label").agg(F.min("least").alias("class_id")), "class-ids")
    known = written(known.join(least, "label").select("set", "label", "class_id", "n_links"), "known")
    no = [F.lit(None).cast(t).alias(c) for c, t in known.dtypes if c != "set"]
    out = found.select("__id", "__hash", "set")
    out = out.where("set is not null").join(known, "set", "left").unionByName(out.where("set is null").select("*", *no))  # nulls would meet in one task
    return out.select("__id", "__hash", F.coalesce("label", "set").alias("class"), F.coalesce("class_id", "__id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id and n_links of classes()."""
    return classes(docs, key, text).select(F.col("__id").alias(key), "class_id", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of docs: of the smallest key, of equal keys the smallest text hash, of equal keys and texts any one.

    Rows without words are classes of their own, but of those with equal key and equal text one stays too. Copies are left out before they are shuffled.
    """
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    found = classes(docs, key, text)
    kept = found.where("class is not null").groupBy("class").agg(F.min(order).alias("m")).select("m.__id", "m.__hash")
    kept = kept.unionByName(found.where("class is null").select("__id", "__hash").distinct())
    inner, names = numbered(docs)
    data = F.encode(F.coalesce(F.col(place(names, text)), F.lit("")), "UTF-8")
    kept = kept.select(F.struct("__id", "__hash").alias("__doc"))
    doc = F.struct(F.col(place(names, key)).alias("__id"), F.xxhash64(data).alias("__hash")).cast(kept.schema["__doc"].dataType)
    # each is kept once; a semi join would be moved before the copies are left out, and shuffle the texts twice
    return inner.withColumn("__doc", doc).dropDuplicates(["__doc"]).join(kept, "__doc").select(*inner.columns).toDF(*names)
