"""Removal of every byte that a repeated string of LENGTH bytes covers, with enhanced suffix arrays.

No suffix array of a whole corpus is made. Every string of LENGTH bytes has an anchor: the place in it of the smallest hash of GRAM bytes. Equal strings have
equal anchors, so a string comes again only if its anchor's bytes do, and all that can repeat around an anchor lies in its context, the bytes less than a string
away. Contexts with the same anchor are brought together; equal ones are repeats as they are, and of the different ones a suffix array with common prefix
lengths is made. A scan of it with a stack gives its intervals of common prefixes; those whose occurrences differ in the byte before are the maximal
repeats, each with all its occurrences.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwork.llm.spans import merged
from ringwork.runtime import numbered, place, written

LENGTH = 200
GRAM = 64
GROUP = 16384  # different contexts of an anchor that one suffix array takes; larger groups are split
ARRAY_BYTES = 1 << 20  # contexts are gathered up to about this size for a suffix array
PIECE = 1 << 17  # places whose hashes are made at once
STEP = 8  # bytes before an anchor by which a large group is split
HOT = 1000  # a context with over one of so many of all occurrences is hot; so there are fewer than HOT of them, whatever the input
WIDE = np.random.RandomState(8).randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TABLE = np.random.RandomState(7).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Places of the anchors of all strings of `length` bytes that lie in one text; data: the texts' bytes, one after another, ends: where each ends."""
    last = len(data) - length + 1
    if last < 1:
        return np.empty(0, np.int64)
    start = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(last + 1, np.int8)
    long = ends - start >= length
    np.add.at(inside, start[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside[:last], dtype=np.int8) > 0
    changes = lambda found: found[np.flatnonzero(np.diff(found, prepend=-1))]  # noqa: E731  they never go back
    return changes(np.concatenate([changes(a + least_places(data[a : a + PIECE + length - 1], length, gram)[inside[a : a + PIECE]]) for a in range(0, last, PIECE)]))


def least_places(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of `length` bytes, where the smallest hash of `gram` bytes in it is, the first of equal ones."""
    window = length - gram + 1
    n = len(data) - gram + 1
    h, size = TABLE[data], 1
    while size < gram:  # the hash of 2 * size bytes from those of size bytes
        h = h[:-size] * np.uint32(2654435761 + 2 * size) + (h[size:] ^ (h[size:] >> np.uint32(15)))
        size *= 2
    least = (h[:n].astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= window:  # the least of 2 * size from those of size
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: size - window], least[window - size :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of `length` bytes from each place on, put together from those of powers of two."""
    n = len(data) - length + 1
    h, size, out, done = WIDE[data], 1, None, 0
    while size <= length:
        if length & size:
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + (part ^ (part >> np.uint64(29)))
            done += size
        if 2 * size <= length:
            h = h[:-size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
    return out


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return n - -(-(int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() // 8)


def suffix_array(texts: list[bytes], places: list[tuple[int, int]], least: int) -> Iterator[tuple[list[int], list[int], list[int], list[int], list[int]]]:
    """The parts of the texts' suffix array in which a maximal repeat of `least` bytes can begin: for each, (text, offset, length of the common prefix with the
    one before, byte before, place) of its suffixes in order.

    A part holds the suffixes that begin with the same `least` bytes. Parts with one suffix, with one place in the corpus, or with one and the same byte before all suffixes
    (whose repeats are parts of longer ones) are left out before anything is sorted. Common prefixes end with their texts.
    """
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # a byte that UTF-8 doesn't have
    some = np.maximum(np.diff(begin) - least, 0)  # suffixes of each text
    n = int(some.sum())
    if n < 2:
        return
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    at = np.arange(n, dtype=kind)
    at += np.repeat((begin[:-1] - np.cumsum(some) + some).astype(kind), some)
    keys = np.empty(n, np.uint64)
    for a in range(0, len(data) - least + 1, PIECE):
        x, y = np.searchsorted(at, [a, a + PIECE])
        keys[x:y] = window_hashes(data[a : a + PIECE + least - 1], least)[at[x:y] - a]
    order = np.argsort(keys, kind="stable").astype(kind)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    del keys
    at = at[order]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), some)[order]
    del order
    offset = at - begin.astype(kind)[text]
    before = np.where(offset > 0, data[at - 1].astype(np.int16), np.int16(-1))
    where = np.array(places, np.int64).reshape(-1, 2)
    place = ((where[:, 0] << 32) + where[:, 1])[text]
    place += offset
    low = np.minimum.reduceat(before, first)
    several = (low != np.maximum.reduceat(before, first)) | (low == -1)
    several &= np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
    ends = np.append(first[1:], n)
    for a, b in zip(first[several].tolist(), ends[several].tolist(), strict=True):
        rest = sorted((texts[t][o + least :], t, o, x, p) for t, o, x, p in zip(text[a:b].tolist(), offset[a:b].tolist(), before[a:b].tolist(), place[a:b].tolist(), strict=True))
        common = [0, *(least + shared(x[0], y[0]) for x, y in zip(rest, rest[1:], strict=False))]
        yield [r[1] for r in rest], [r[2] for r in rest], common, [r[3] for r in rest], [r[4] for r in rest]


def intervals(common: list[int], before: list[int], place: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats among suffixes in order.

    common: each suffix's prefix in common with the one before it; before: the byte before each, -1 if none is known;
    place: where in the corpus each starts. Intervals whose bytes before are all the same are parts of longer repeats, and those that start at
    one place only are no repeats.
    """
    out, stack = [], []
    n = len(common)
    for i in range(1, n + 1):
        h = common[i] if i < n else 0
        first, left, low, high = i - 1, before[i - 1], place[i - 1], place[i - 1]
        while stack and stack[-1][0] > h:
            size, first, l2, low2, high2 = stack.pop()
            left = left if left == l2 else -1
            low, high = min(low, low2), max(high, high2)
            if left == -1 and low != high:
                out.append((size, first, i - 1))
        if h >= least:
            if stack and stack[-1][0] == h:
                size, f2, l2, low2, high2 = stack[-1]
                stack[-1] = (h, f2, left if left == l2 else -1, min(low, low2), max(high, high2))
            else:
                stack.append((h, first, left, low, high))
    return out


def repeats(texts: list[bytes], places: list[tuple[int, int]], least: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences) of the maximal repeats of the texts; occurrences: (text, offset).

    places: (document, offset) of each text, so that parts of a document that lie in two texts don't count as repeats of each other.
    """
    for text, offset, common, before, place in suffix_array(texts, places, least):
        for size, first, last in intervals(common, before, place, least):
            yield size, list(zip(text[first : last + 1], offset[first : last + 1], strict=True))


def may_repeat(texts: list[bytes], offs: list[int], least: int = LENGTH) -> list[int]:
    """Those of the contexts of one anchor that could hold `least` bytes around it in common with another: by the longest beginnings in common after and before the anchor."""
    reach = [0] * len(texts)
    for side in ([t[o:] for t, o in zip(texts, offs, strict=True)], [t[:o][::-1] for t, o in zip(texts, offs, strict=True)]):
        order = sorted(range(len(texts)), key=side.__getitem__)
        near = [0] * len(texts)
        for i, j in zip(order, order[1:], strict=False):
            n = shared(side[i], side[j])
            near[i], near[j] = max(near[i], n), max(near[j], n)
        reach = [r + x for r, x in zip(reach, near, strict=True)]
    return [k for k, r in enumerate(reach) if r >= least]


def covered_parts(texts: list[bytes], places: list[tuple[int, int]], least: int = LENGTH) -> list[tuple[int, int, int]]:
    """(text, start, end) of the maximal parts of the texts that repeats cover."""
    texts_of, starts, stops = array("q"), array("q"), array("q")  # of the longest repeat that begins at each suffix
    for text, offset, common, before, place in suffix_array(texts, places, least):
        # of the repeats that begin at a suffix only the longest matters; inner intervals come before outer ones
        onward = list(range(len(text) + 1))
        for size, first, last in intervals(common, before, place, least):
            i = first
            while i <= last:
                if onward[i] == i:
                    texts_of.append(text[i])
                    starts.append(offset[i])
                    stops.append(offset[i] + size)
                    onward[i] = last + 1
                    i += 1
                else:
                    onward[i], i = max(onward[i], last + 1), onward[i]
    if not texts_of:
        return []
    t, s, e = (np.frombuffer(x, np.int64) for x in (texts_of, starts, stops))
    order = np.lexsort((s, t))
    t, s, e = t[order], s[order], e[order]
    base = t * (e.max() + 1)  # parts of different texts are apart
    reach = np.maximum.accumulate(base + e)
    first = np.flatnonzero(np.concatenate([[True], (base + s)[1:] > reach[:-1]]))
    end = (reach - base)[np.append(first[1:], len(t)) - 1]
    return list(zip(t[first].tolist(), s[first].tolist(), end.tolist(), strict=True))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__id, __hash, __bytes of each row; rows of equal key and equal text are one document."""
    data = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    return docs.select(F.col(f"`{key}`").alias("__id"), F.xxhash64(data).alias("__hash"), data.alias("__bytes"))


def anchor_rows(rows: DataFrame, size: int = 128) -> DataFrame:
    """a (hash of an anchor's bytes), c (hash of its context), __id, __hash, lo, hi (of the context), off (of the anchor in it)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, ctx = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                texts = b.column(2).to_pylist()
                joined = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                found = anchors(np.frombuffer(joined, np.uint8), ends)
                text = np.searchsorted(ends, found, side="right")
                start = np.concatenate([[0], ends[:-1]])[text]
                lo = np.maximum(start, found - (LENGTH - GRAM))
                hi = np.minimum(ends[text], found + LENGTH)
                f, low, high = found.tolist(), lo.tolist(), hi.tolist()
                a = np.array([gram(joined[x : x + GRAM]) for x in f], np.uint64).view(np.int64)
                c = np.array([ctx(joined[x:y], z - x) for x, y, z in zip(low, high, f, strict=True)], np.uint64).view(np.int64)
                taken = pa.array(text)
                ints = [pa.array(x.astype(np.int32)) for x in (lo - start, hi - start, found - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), b.column(0).take(taken), b.column(1).take(taken), *ints], names=["a", "c", "__id", "__hash", "lo", "hi", "off"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"a long, c long, __id {kind}, __hash long, lo int, hi int, off int")


def packed(rows: DataFrame) -> DataFrame:
    """rows of keyed() with their bytes compressed, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        press = zstd.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(x) for x in b.column(2).to_pylist()], pa.binary())], names=["__id", "__hash", "__z"])

    return rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, __hash long, __z binary")


def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left with the columns of right, on the same document."""
    right = right.withColumnsRenamed({"__id": "__id2", "__hash": "__hash2"})
    return left.join(right, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), how).drop("__id2", "__hash2")


def contexts(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """reps (g, n, __id, __hash, lo, hi, off) with ctx, the bytes of each context.

    Documents and reps are sorted together, once: a task reads a document, or its repeated rows, and then the reps that lie in it.
    """
    kind = reps.schema["__id"].dataType.simpleString()
    names = ["g", "n", "__id", "__hash", "lo", "hi", "off"]
    no = [F.lit(None).cast(t).alias(c) for c, t in (("g", "long"), ("n", "long"), ("lo", "int"), ("hi", "int"), ("off", "int"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        press = zstd.ZstdDecompressor()
        held = data = None
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                row, out = [], []
                for k, (lo, hi, z) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(7).to_pylist(), strict=True)):
                    if z is not None:
                        held, data = z, None
                        continue
                    if data is None:
                        data = press.decompress(held)
                    row.append(k)
                    out.append(data[lo:hi])
                if out:
                    taken = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(taken) for k in range(7)), pa.array(out, pa.binary())], names=[*names, "ctx"])

    both = packed(docs).select("*", *no).select(*names, "__z").unionByName(reps.select(*names, F.lit(None).cast("binary").alias("__z")))
    both = both.repartition("__id", "__hash").sortWithinPartitions("__id", "__hash", F.col("g").asc_nulls_first())
    return both.mapInArrow(run, f"g long, n long, __id {kind}, __hash long, lo int, hi int, off int, ctx binary")


def arrayed(groups: DataFrame) -> DataFrame:
    """__id, __hash, s, e of the parts that repeats cover in contexts that come once; groups of one g are in one task, of at most GROUP contexts."""
    kind = groups.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # contexts for the next suffix array
        group: list[tuple] = []  # the anchor's that is being read
        size = 0

        def solve(schema) -> pa.RecordBatch | None:
            names: dict[tuple, int] = {}
            places = [(names.setdefault((r[2], r[3]), len(names)), r[4]) for r in held]
            found = [(held[t], s, e) for t, s, e in covered_parts([r[7] for r in held], places) if held[t][1] == 1]
            held.clear()
            if not found:
                return None
            ids = pa.array([r[2] for r, _, _ in found], schema.field("__id").type)
            hashes = pa.array([r[3] for r, _, _ in found], pa.int64())
            return pa.RecordBatch.from_arrays([ids, hashes, pa.array([r[4] + s for r, s, _ in found], pa.int32()), pa.array([r[4] + e for r, _, e in found], pa.int32())], names=["__id", "__hash", "s", "e"])

        def take() -> int:
            some = [group[k] for k in may_repeat([r[7] for r in group], [r[6] for r in group])]
            held.extend(some)
            group.clear()
            return sum(len(r[7]) for r in some)

        schema = None
        for whole in batches:
            schema = whole.schema
            for at in range(0, whole.num_rows, 1000):
                for r in zip(*(c.to_pylist() for c in whole.slice(at, 1000).columns), strict=True):
                    if group and r[0] != group[0][0]:
                        size += take()
                        if size >= ARRAY_BYTES:
                            size = 0
                            if (out := solve(schema)) is not None:
                                yield out
                    group.append(r)
        if group:
            take()
        if held and (out := solve(schema)) is not None:
            yield out

    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"__id {kind}, __hash long, s int, e int")


def several(at: str) -> Column:
    """Aggregate: whether occurrences are at more than one place; those of rows of equal key and equal text are at the same."""
    place = F.xxhash64("__id", "__hash", at)
    return F.min(place) != F.max(place)


def split_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Groups of at most GROUP contexts, and the spans found while larger ones were split (None: none was larger).

    Two contexts share a string that reaches STEP bytes before the anchor only if those bytes are equal, so a large group is split by them; the
    few strings that reach less far are compared by two hashes. What is left is split by the next STEP bytes, until no group is large.
    """
    small, spans = None, None
    union = lambda a, b: b if a is None else a.unionByName(b)
    for level in range(-(-(LENGTH - GRAM + 1) // STEP)):
        hot = groups.groupBy("g").count().where(F.col("count") > GROUP).select("g")
        hot = written(hot, "large-groups")
        if hot.isEmpty():
            return union(small, groups), spans
        small = union(small, groups.join(hot, "g", "left_anti"))
        large = groups.join(hot, "g", "left_semi")
        reach = F.explode(F.sequence(F.lit(level * STEP), F.lit(level * STEP + STEP - 1))).alias("x")
        strings = large.select("*", reach).where("off >= x").withColumn("w", F.expr(f"substring(ctx, off - x + 1, {LENGTH})")).where(F.length("w") == LENGTH)
        strings = strings.select("g", "x", F.xxhash64("w").alias("h"), F.hash("w").alias("k"), "n", "__id", "__hash", (F.col("lo") + F.col("off") - F.col("x")).alias("s"))
        again = strings.groupBy("g", "x", "h", "k").agg(several("s").alias("m")).where("m").drop("m")
        found = strings.join(written(again, "strings"), ["g", "x", "h", "k"]).where("n = 1")
        spans = union(spans, written(found.select("__id", "__hash", "s", (F.col("s") + LENGTH).alias("e")), "spans"))
        near = F.expr(f"substring(ctx, off - {level * STEP + STEP} + 1, {STEP})")
        groups = written(large.where(F.col("off") >= level * STEP + STEP).withColumn("g", F.xxhash64("g", near)), "groups")
    return union(small, groups.where("false")), spans


def repeated_spans(docs: DataFrame) -> DataFrame:
    """__id, __hash, __spans (merged intervals of bytes) of the documents of keyed() that hold a repeated string."""
    rows = written(anchor_rows(docs), "all-anchors")
    again = rows.groupBy("a").agg(F.count("*").alias("t"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("t > 1")
    again = written(again.select("a", (F.col("c1") != F.col("c2")).alias("differ")), "anchors")
    found = written(rows.join(again, "a"), "occurrences")  # anchors of strings that may come again, and no others
    first = [F.first(c).alias(c) for c in ("__id", "__hash", "lo", "hi", "off")]
    kinds = written(found.groupBy("a", "c").agg(F.when(several("lo"), F.count("*")).otherwise(1).alias("n"), F.first("differ").alias("differ"), *first), "contexts")
    # the occurrences of a hot context would meet in one task of a join; hot ones are so few by definition that each task can have their list
    many = max(HOT, found.count() // HOT)
    hot = F.broadcast(kinds.where(F.col("n") > many).select("a", "c"))
    equal = found.join(hot, ["a", "c"], "left_anti").join(kinds.where((F.col("n") > 1) & (F.col("n") <= many)).select("a", "c"), ["a", "c"])
    equal = equal.unionByName(found.join(hot, ["a", "c"])).where(F.col("hi") - F.col("lo") >= LENGTH)
    spans = equal.select("__id", "__hash", F.col("lo").alias("s"), F.col("hi").alias("e"))
    reps = kinds.where("differ").select(F.col("a").alias("g"), "n", "__id", "__hash", "lo", "hi", "off")
    small, more = split_groups(written(contexts(reps, docs), "groups"))
    spans = spans.unionByName(arrayed(small))
    if more is not None:
        spans = spans.unionByName(more)
    return spans.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("p")).select("__id", "__hash", merged(F.col("p")).alias("__spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """key, n_bytes, spans (array of struct s, e: the maximal removed runs of bytes) and kept (the other bytes) of each row.

    A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in the same text or another. as_text: spans are narrowed to
    whole characters and kept is a string. Null and empty texts keep nothing and lose nothing; texts may be of any length; rows of equal key and equal text are one
    document, rows of equal keys and different texts are different ones; null keys are keys; other columns are left aside, whatever they are called; an
    empty table gives no rows.
    """
    rows = keyed(docs, key, text)
    both = joined(packed(rows), repeated_spans(rows), "left").select("__id", "__z", "__spans")
    kind = rows.schema["__id"].dataType.simpleString()
    name = key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        press = zstd.ZstdDecompressor()
        struct = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sizes, spans, kept = [], [], []
                for z, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    data = press.decompress(z)
                    found = [(x["s"], x["e"]) for x in found or ()]
                    if as_text:
                        found = [w for w in (whole_characters(data, s, e) for s, e in found) if w[0] < w[1]]
                    cuts = [0, *(y for x in found for y in x), len(data)]
                    out = b"".join(data[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                    sizes.append(len(data))
                    spans.append([{"s": s, "e": e} for s, e in found])
                    kept.append(out.decode() if as_text else out)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, struct), pa.array(kept, pa.string() if as_text else pa.binary())], names=[name, "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, f"`{name}` {kind}, n_bytes long, spans array<struct<s:int,e:int>>, kept {'string' if as_text else 'binary'}")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the bytes of remove_repeats() gone from their texts, narrowed to whole characters.

    Other columns pass unchanged, whatever they are called. A null text stays null, an empty one empty; texts may be of any length; rows of equal key and equal text are one
    document and lose the same, rows of equal keys and different texts are different documents; null keys are keys; an empty table gives no rows.
    """
    spans = repeated_spans(keyed(docs, key, text))
    inner, names = numbered(docs)
    text = place(names, text)
    named = inner.withColumns({"__id": F.col(place(names, key)), "__hash": F.xxhash64(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))})
    both = joined(named, spans, "left").select(*inner.columns, "__spans")
    numbers = inner.columns
    at_text = numbers.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for t, found in zip(b.column(at_text).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                    if found:
                        data, end, parts = t.encode(), 0, []
                        for x in found:
                            s, e = whole_characters(data, x["s"], x["e"])
                            parts.append(data[end:s])
                            end = e
                        t = b"".join([*parts, data[end:]]).decode()
                    out.append(t)
                columns = [pa.array(out, pa.string()) if k == at_text else b.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=numbers)

    return both.mapInArrow(run, inner.schema).toDF(*names)


def whole_characters(data: bytes, s: int, e: int) -> tuple[int, int]:
    """The part of s..e that begins and ends between characters of UTF-8."""
    while s < e and data[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
        e -= 1
    return s, e
