"""Removal of later copies of repeated runs of lines or sentences.

Both operators hash every run, find the hashes that come more than once, keep the first occurrence (smallest document key, then smallest place) and
remove from a text what any later occurrence covers. Rows with equal key and equal text are one document: they lose the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwork.runtime import numbered, place, written

LINES = 3  # lines of a window
RUN_SENTENCES, RUN_WORDS = 2, 16  # a run of sentences has at least as many of both
LONG_SENTENCE = 32  # words from which a sentence is a run by itself
SENTENCE = re.compile(r".+?(?:[.!?]+\s+|\n+|\Z)", re.DOTALL | re.ASCII)
WORD = re.compile(r"\S+", re.ASCII)


def merged(pairs: Column) -> Column:
    """Sorted array of struct(s, e), as the fewest intervals that cover the same."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e")))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] >= x["s"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), wider)).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pairs, empty, step)


def covered(spans: DataFrame) -> DataFrame:
    """spans: __id, __hash (of the document), s, e, h, g -> __id, __hash, __spans (merged intervals of later occurrences).

    The first occurrences are aggregated before they are shuffled and joined back as a written table of repeated hashes alone, so that the
    occurrences of a very common run are split among tasks. A document's own spans are the only ones that meet in one row.
    """
    at = F.struct("__id", "__hash", "s")
    first = spans.groupBy("h", "g").agg(F.min(at).alias("__first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = spans.join(written(first, "first-runs"), ["h", "g"]).where(~at.eqNullSafe(F.col("__first")))
    return later.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("p")).select("__id", "__hash", merged(F.col("p")).alias("__spans"))


def identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str], str]:
    """Numbered docs with __id and __hash, their names, and the text's column."""
    docs, names = numbered(docs)
    text = place(names, text)
    return docs.withColumns({"__id": F.col(place(names, key)), "__hash": F.xxhash64(text)}), names, text


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs of identified() with __spans, null where nothing is covered."""
    right = covered(spans)
    right = right.select(F.col("__id").alias("__id2"), F.col("__hash").alias("__hash2"), "__spans")
    on = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2"))
    return docs.join(right, on, "left").drop("__id2", "__hash2")


def gaps(size: Column) -> Column:
    """Array of struct(a, n): start and size of what __spans leaves of 0..size."""
    spans = F.coalesce(F.col("__spans"), F.array().cast("array<struct<s:int,e:int>>"))
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
    ends = F.concat(F.transform(spans, lambda x: x["s"]), F.array(size))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))


def replaced(joined: DataFrame, names: list[str], text: str, kept: Column, size: Column, report: str | None) -> DataFrame:
    """The columns by their names with the new text, and a struct of what was removed if `report` names it."""
    n_removed = F.coalesce(F.aggregate("__spans", F.lit(0), lambda acc, x: acc + x["e"] - x["s"]), F.lit(0))
    new = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)
    columns = [(new if text == f"c{k}" else F.col(f"c{k}")).alias(c) for k, c in enumerate(names) if c != report]
    if report:
        n_spans = F.coalesce(F.size("__spans"), F.lit(0))
        n_spans = F.when(F.col("__spans").isNull(), 0).otherwise(n_spans)
        columns.append(F.struct(size.cast("long").alias("n"), n_removed.cast("long").alias("n_removed"), n_spans.cast("long").alias("n_spans")).alias(report))
    return joined.select(*columns)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", report: str | None = None) -> DataFrame:
    """docs, with the lines gone that a later occurrence of a repeated window of LINES lines covers; DataFrame functions only.

    Windows overlap, are compared by two hashes of 96 bits together, and count whether they come again in the same text or another; windows
    without any visible character don't count. Texts of fewer lines, empty texts and null texts stay as they are; texts may be of any length. A null key comes first; of rows
    with one key and different texts the smaller hash of the text does; repeated rows are one document and lose the same. An empty table gives no rows. Other
    columns pass unchanged, whatever they are called; `report` adds a struct of n (lines), n_removed and n_spans, in place of a column of that name.
    """
    named, names, text = identified(docs, key, text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def window(i: Column) -> Column:
        three = [F.get(F.col("__lines"), i + k) for k in range(LINES)]
        blank = ~F.concat(*three).rlike(r"\S")
        return F.when(~blank, F.struct(F.xxhash64(*three).alias("h"), F.hash(*three).alias("g")))

    cut = named.select("__id", "__hash", lines.alias("__lines")).where(F.size("__lines") >= LINES)
    windows = cut.select("__id", "__hash", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("__lines") - LINES), window)).alias("s", "w"))
    windows = windows.where("w is not null").select("__id", "__hash", "s", (F.col("s") + LINES).alias("e"), "w.h", "w.g")
    joined = with_spans(named, windows).withColumn("__lines", lines)
    kept = F.array_join(F.flatten(F.transform(gaps(F.size("__lines")), lambda x: F.slice(F.col("__lines"), x["a"] + 1, x["n"]))), "\n")
    return replaced(joined, names, text, kept, F.size("__lines"), report)


def runs_of(text: str, window: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, normal form) of the runs of sentences of a text, in code points.

    From each sentence on, and back from each, the shortest run of at least RUN_SENTENCES and RUN_WORDS; and each sentence of
    LONG_SENTENCE words; with `window` also every run of so many sentences with any word. The same run is given once. The normal form leaves out the space around sentences.
    """
    bounds = [m.span() for m in SENTENCE.finditer(text)]
    words = [len(WORD.findall(text, a, b)) for a, b in bounds]
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(bounds)
    ends = np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS), np.arange(n) + RUN_SENTENCES)
    starts = np.minimum(np.searchsorted(total, total[1:] - RUN_WORDS, side="right") - 1, np.arange(n) + 1 - RUN_SENTENCES)
    found = {(i, int(j)) for i, j in enumerate(ends) if j <= n}
    found.update((int(i), j + 1) for j, i in enumerate(starts) if i >= 0)
    found.update((i, i + 1) for i, w in enumerate(words) if w >= LONG_SENTENCE)
    found.update((i, i + window) for i in range(n - window + 1) if window and total[i + window] > total[i])
    plain = [text[a:b].strip(" \t\n\r\f\v") for a, b in bounds]
    return [(bounds[i][0], bounds[j - 1][1], "\n".join(plain[i:j])) for i, j in sorted(found)]


def sentence_runs(named: DataFrame, text: str, window: int = 0, rows: int = 256) -> DataFrame:
    """__id, __hash, s, e, h, g of each run of each distinct text of a batch."""
    import xxhash

    picked = named.select("__id", "__hash", F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                row, s, e, h = [], [], [], []
                for k, t in enumerate(b.column(2).to_pylist()):
                    for x, y, plain in runs_of(t, window) if t else ():
                        row.append(k)
                        s.append(x)
                        e.append(y)
                        h.append(xxhash.xxh3_128_digest(plain.encode()))
                both = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["__id", "__hash", "s", "e", "h", "g"])

    kind = named.schema["__id"].dataType.simpleString()
    return picked.mapInArrow(run, f"__id {kind}, __hash long, s int, e int, h long, g long")


def dedup_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", report: str | None = None, window: int = 0) -> DataFrame:
    """docs, with the sentences gone that a later occurrence of a repeated run of sentences covers.

    A sentence ends after its marks and the space behind them, or at a line's end; runs are those of runs_of(), so repeats of a few
    short sentences stay unless `window` is given. Null and empty texts stay as they are; texts may be of any length. A null key comes first; of rows
    with one key and different texts the smaller hash of the text does; repeated rows are one document and lose the same. An empty table gives no rows. Other columns
    pass unchanged, whatever they are called; `report` adds a struct of n (code points), n_removed and n_spans, in place of a column of that name.
    """
    named, names, text = identified(docs, key, text)
    joined = with_spans(named, sentence_runs(named, text, window))
    size = F.coalesce(F.length(text), F.lit(0))
    kept = F.array_join(F.transform(gaps(size), lambda x: F.col(text).substr(x["a"] + 1, x["n"])), "")
    return replaced(joined, names, text, kept, size, report)
