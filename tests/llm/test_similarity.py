"""Jaccard join, sketches and components against brute force."""

import random
import re
import struct

import numpy as np
import pytest
import xxhash

from ringwork.llm import fingerprints, graph, jaccard
from ringwork.llm.queries import QUERIES
from tests_path import SF


def shingle_set(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts, copies=()):
    """(class, links) by key; copies: keys whose rows come twice."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    near = {k: {j for j in sets if j != k and sets[k] and sets[j] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])} for k in sets}
    out = {}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[k] = (min(seen), sum(1 + (j in copies) for j in near[k]) + (k in copies and bool(sets[k])))
    return out


def test_linked(docs, unique, nothing):
    rows = jaccard.linked(docs).collect()
    want = brute_classes(unique, copies=(12,))
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["class_id"], r["n_links"]) == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["class_id"] is None and r["n_links"] == 0
    assert any(n for _, n in want.values()) and jaccard.linked(nothing).collect() == []


@pytest.mark.parametrize(("bucket", "block"), [(4, 5), (8, 1500)])
def test_large_groups(spark, bucket, block, monkeypatch):
    """Groups larger than buckets and blocks lose no link."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(bucket)
    base = [f"w{rng.randrange(5000)}" for _ in range(220)]
    texts = {}
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        texts[k] = " ".join(w) if k % 3 else " ".join(base[:110] + [f"u{rng.randrange(9999)}" for _ in range(110)])
    rows = jaccard.linked(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == brute_classes(texts)


def test_runs():
    assert jaccard.runs_for(0.8, 0.99) < jaccard.runs_for(0.8, 0.9999) < jaccard.runs_for(0.5, 0.9999)


def test_pairs_lost_by_sketches_are_counted():
    """Not met in any run, or met and not a candidate: together below 1 - RECALL for a pair at the threshold, by sums of their own."""
    rng = np.random.RandomState(3)
    one = rng.randint(0, 1 << 31, jaccard.COORDINATES).astype(np.int32)
    other = np.where(np.arange(jaccard.COORDINATES) < 36, one, one ^ 1)
    found = jaccard.bucket_edges([{"set": 1, "sketch": one.tolist()}, {"set": 2, "sketch": other.tolist()}])
    assert found == [(2, 1)]
    chance = np.array([1.0])
    for _ in range(jaccard.COORDINATES):
        chance = np.convolve(chance, [0.2, 0.8])
    runs = jaccard.runs_for(0.8, jaccard.RECALL)
    met = 0.8 * (1 - 0.2**jaccard.BRANCHES) ** jaccard.LEVELS
    least = next(k for k in range(jaccard.COORDINATES) if k >= (0.8 - jaccard.MARGIN) * jaccard.COORDINATES)
    assert chance[:least].sum() + (1 - met) ** runs < 1 - jaccard.RECALL


def test_common():
    rng = np.random.RandomState(0)
    sets = [np.unique(rng.randint(0, 400, rng.randint(1, 300)).astype(np.uint64)) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets], np.float32)
    got = jaccard.common(sets)
    off = ~np.eye(70, dtype=bool)
    assert (got[off] == want[off]).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 240)]
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys((1, 2, 3), 1), 8: 8, 9: 8, **dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(200, 240), 200)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_sketch(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]

    def chained(run):
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(struct.pack("<q", w), seed=h)
        return signed(h)

    hashes = [chained(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [chained(words)] if words else []
    kept = sorted({h for h in hashes if h < -(1 << 63) + (1 << 64) // fingerprints.SCALE})
    return kept if kept or not hashes else [min(hashes)]


def brute_fingerprints(texts):
    """(n, edited, sketch, edited sketch, next sketch) by key."""
    order = sorted(texts, reverse=True)
    sketches = {k: brute_sketch(texts[k]) for k in order}
    out = {}
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        t, u = texts[k] or "", texts[after] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        out[k] = (len(t), edited, sketches[k], brute_sketch(edited), sketches[after])
    return out


@pytest.mark.parametrize("ranges", [2, 7])
def test_sketches(spark, docs, unique, nothing, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
        got = {r["doc_id"]: (len(r["text"]), r["edited"], r["sketch"], r["edited_sketch"], r["next_sketch"]) for r in fingerprints.fingerprints(table).collect()}
        assert got == brute_fingerprints(unique)
        assert fingerprints.fingerprints(docs).count() == docs.count() and fingerprints.fingerprints(nothing).collect() == []
        one = fingerprints.fingerprints(docs.where("doc_id = 9")).first()
        assert one["sketch"] == one["next_sketch"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_likeness_and_merging(spark):
    from pyspark.sql import functions as F

    def a(*x):
        return F.array(*[F.lit(v).cast("bigint") for v in x]) if x else F.array().cast("array<bigint>")

    low = -(1 << 63)
    df = spark.createDataFrame([([low + 1, low + 5],), ([low + 5, low + 9],), ([],)], "s array<bigint>")
    r = spark.range(1).select(fingerprints.likeness(a(1, 2, 3), a(2, 3, 4)).alias("l"), fingerprints.likeness(a(), a()).alias("e"), fingerprints.likeness(a(1), a()).alias("z"), fingerprints.containment(a(1, 2), a(1, 2, 3, 4)).alias("c")).first()
    assert tuple(r) == (0.5, 1.0, 0.0, 1.0) and df.agg(fingerprints.merged(F.col("s")).alias("m")).first()["m"] == [low + 1, low + 5, low + 9]


def test_keys_of_sketches_are_numbers(spark):
    with pytest.raises(TypeError):
        fingerprints.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_sketch_query(spark):
    import hashlib

    def printed(s):
        return ",".join(f"{h & (1 << 64) - 1:016X}" for h in s)

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0

    want = brute_fingerprints({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})
    for r in QUERIES["op9_fingerprints"](spark, SF).collect():
        n, edited, own, changed, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, hashlib.sha256(edited.encode()).hexdigest(), printed(own), printed(changed))
        assert (r["near_edited"], r["near_next"]) == (alike(own, changed), alike(own, after))
