"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from texts confirmed as toxic and from texts taken as unlabelled,
of which the class prior says how many are toxic. The risk of the unlabelled as negatives, less the positives' part in it, is kept from falling
below zero: where it does, the step goes the other way, so that the classifier does not fit the unlabelled texts' own positives as negatives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ringwork.llm.held import LIMIT, Held
from ringwork.runtime import numbered, place

BITS = 17  # of a feature's hash
MARKS = re.compile(r"[^\w]+")
PREFIXES = (4, 5, 6)  # characters of a word's beginnings that count as features
MAX_POSITIVES, MAX_UNLABELLED, MAX_BYTES = 2000, 4000, 64 << 20  # bounds of what the driver trains on
APART = 4.0  # standard errors by which a feature's share of the positives differs from that of the unlabelled, to be used
STEPS, RATE, DECAY = 200, 0.6, 1e-5


def feature_ids(word: str) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(x.encode()) & ((1 << BITS) - 1) for x in (f"={word}", *(f"{k}^{word[:k]}" for k in PREFIXES))]


def words_of(text: str | None) -> list[str]:
    return [w for w in MARKS.split(text.lower()) if w] if text else []


def counted(texts: list[str | None], held: Held, ids_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the whole texts: the square root of a feature's count among the text's words. held: known words' ids as bytes."""
    held.turn()
    parts, sizes = [], []
    for t in texts:
        words = words_of(t)
        held.add({w: np.array(ids_of(w), "<i4").tobytes() for w in held.unknown(words)})
        parts.append(b"".join(map(held.now.__getitem__, words)))
        sizes.append(len(words))
    rows = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in parts])
    keys, counts = np.unique((rows << BITS) | np.frombuffer(b"".join(parts), "<i4").astype(np.int64), return_counts=True)
    rows = keys >> BITS
    return rows, keys & ((1 << BITS) - 1), np.sqrt(counts / np.maximum(np.array(sizes)[rows], 1))


@dataclass
class Model:
    """g(x) = x . weights + bias over the features that training kept; the score is g's sigmoid."""

    weights: dict[int, float]
    bias: float

    def score(self, texts: list[str | None], held: Held | None = None) -> np.ndarray:
        """0 to 1 for each whole text; a null or empty text has the bias alone. held: words met by this model before."""
        dense = np.zeros(1 << BITS)
        dense[list(self.weights)] = list(self.weights.values())
        rows, ids, values = counted(texts, held or Held(), lambda w: [i for i in feature_ids(w) if i in self.weights])
        g = np.bincount(rows, values * dense[ids], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def train(positive: list[str | None], unlabelled: list[str | None], prior: float) -> Model:
    """nnPU with the logistic loss and Adam over whole samples; without positives or with a prior of 0 all scores are low."""
    dim = 1 << BITS
    if not positive or not unlabelled or prior <= 0:
        return Model({}, -5.0)
    prior = min(prior, 0.9)
    n, m = len(positive), len(unlabelled)
    held = Held()

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, n + m, 128):
            r, i, v = counted([positive[k] if k < n else unlabelled[k - n] for k in range(at, min(at + 128, n + m))], held, feature_ids)
            yield (r + at).astype(np.int32), i.astype(np.int32), v.astype(np.float32)

    # once to choose the features and once for their values, so that the others' values are never held together
    seen, among = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for r, i, _ in pieces():
        seen += np.bincount(i, minlength=dim)
        among += np.bincount(i[r < n], minlength=dim)
    share = np.clip(seen / (n + m), 1e-9, 1 - 1e-9)
    apart = (among / n - (seen - among) / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    used = np.flatnonzero((np.abs(apart) >= APART) & (seen >= 3))
    if not len(used):
        return Model({}, float(np.log(prior / (1 - prior))))
    number = np.full(dim, -1, np.int32)
    number[used] = np.arange(len(used))
    scale = np.log((n + m) / seen[used]).astype(np.float32)  # rare features count more
    kept = [(r[number[i] >= 0], number[i[number[i] >= 0]], v[number[i] >= 0]) for r, i, v in pieces()]
    rows, ids, values = (np.concatenate(x) for x in zip(*kept, strict=True))
    values = values * scale[ids]
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        g = np.bincount(rows, values * w[ids], n + m) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        sp, su = s[:n], s[n:]
        loss = lambda z: np.logaddexp(0, -z)
        negative = loss(-g[n:]).mean() - prior * loss(-g[:n]).mean()
        up = np.concatenate([prior * (sp - 1) / n, np.zeros(m)])  # of the positives' risk
        down = np.concatenate([-prior * sp / n, su / m])  # of the corrected negatives' risk
        slope = up + down if negative >= 0 else -down
        grad = np.append(np.bincount(ids, values * slope[rows], len(used)) + DECAY * w, slope.sum())
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        move = RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w -= move[:-1]
        b -= move[-1]
    return Model(dict(zip(used.tolist(), (w * scale).tolist(), strict=True)), float(b))


def fold(key: Column) -> Column:
    """Whether a row is held out from training: crc32 of its key as text, modulo 5, is 0. A null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, max_bytes: int = MAX_BYTES) -> Model:
    """A model from texts confirmed as positive and from unlabelled texts, none of them held out.

    At most the texts of max_positives rows with label 1, and of max_unlabelled rows of docs, whether they have labels or not (training does not see them), both in the order of
    their keys' hash, and of either as many as have max_bytes together; that bounds what the driver holds. The class prior is the share of 1 among all labelled rows that are not held out, which are taken as a fair sample of docs. Rows with null keys or
    labels are left out; a null text counts as empty; a key with several rows or texts gives each of them; without rows all scores are low. Columns of other names are not looked at.
    """
    rows = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").alias("__label")).where(F.col("__label").isNotNull() & F.col("__key").isNotNull() & ~fold(F.col("__key")))
    prior = rows.agg(F.avg((F.col("__label") == 1).cast("double"))).first()[0] or 0.0
    order = [F.xxhash64("__key"), F.col("__key")]
    picked = rows.where("__label = 1").orderBy(*order).limit(max_positives).select("__key", F.lit(True).alias("__positive"))
    given = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).where(F.col("__key").isNotNull() & ~fold(F.col("__key")))
    picked = picked.unionByName(given.select("__key", F.lit(False).alias("__positive")).orderBy(*order).limit(max_unlabelled)).distinct()
    texts = given.join(F.broadcast(picked), "__key")
    upto = F.sum(F.octet_length(F.coalesce("__text", F.lit("")))).over(Window.partitionBy("__positive").orderBy(*order, F.xxhash64("__text")))
    texts = texts.withColumn("__upto", upto).where(F.col("__upto") <= max_bytes).select("__positive", "__text").collect()
    return train(sorted(r[1] or "" for r in texts if r[0]), sorted(r[1] or "" for r in texts if not r[0]), prior)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", rows: int = 512) -> DataFrame:
    """docs with a column of scores, in place of one of that name; one pass, no shuffle.

    Null and empty texts get the bias's score; texts are scored whole, whatever their length; equal texts get equal scores, and repeated rows and ties of keys make no difference; an
    empty table gives no rows; other columns pass unchanged, whatever they are called.
    """
    docs, names = numbered(docs.drop(score) if score in docs.columns else docs)
    at_text = docs.columns.index(place(names, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(LIMIT // 2)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(at_text).to_pylist(), held))], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())])).toDF(*names, score)
