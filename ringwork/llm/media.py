"""Lossless media of texts in a store of content-defined chunks.

A text's bytes, padded to whole frames, become 8-bit samples of a WAV file. A rolling gear hash cuts the file into chunks where its bytes say so, and Spark joins on the
chunks' digests find those that come more than once; the first place of each owns it. A second pass over the texts writes a row for
each file: its ordered list of chunks and the bytes of those that it owns. Reading goes the other way: chunks of other files are joined in, the
list puts the file together, and the digests of the chunks and of the file must agree.

No text is shuffled: what a task of the second pass must know about its files is written to a table by the number of the task that saw them in the
first, and read from there. Both passes must see the same partitions, as reads of files do; a task that misses one of its files fails.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from ringwork.llm.suffixes import keyed
from ringwork.llm.warc import opened
from ringwork.runtime import scratch, written

FRAME = 192  # samples of a frame; a payload is a positive number of frames
RATE = 8000
HEADER = 44
LEAST, MASK_BITS, MOST = 1024, 12, 16384  # bytes of a chunk: at least, as a power of two beyond that on average, at most
GEAR = np.random.RandomState(23).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
TABLES = 4096  # most parts of the table between the passes


class MediaError(ValueError):
    """Stored bytes that are not what was stored."""


def media_of(data: bytes) -> bytes:
    """A WAV file (mono, 8-bit) whose samples are the bytes, with spaces up to whole frames."""
    size = max(FRAME, -(-len(data) // FRAME) * FRAME)
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size) + data + b" " * (size - len(data))


def samples_of(media: bytes) -> bytes:
    """The samples of such a file; MediaError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or struct.unpack("<HHIIHH", media[20:36]) != (1, 1, RATE, RATE, 1, 8):
        raise MediaError("not an 8-bit mono WAV file")
    size = struct.unpack("<I", media[40:44])[0]
    if len(media) != HEADER + size or struct.unpack("<I", media[4:8])[0] != 36 + size or size % FRAME or not size:
        raise MediaError("a length in the header is not that of the samples")
    return media[HEADER:]


def chunks_of(media: bytes) -> list[tuple[int, int]]:
    """The chunks of a file. A cut follows each byte at which the hash of the 32 bytes up to it has MASK_BITS leading zeros, and LEAST bytes or more lie behind the last cut; after MOST bytes there is a cut anyway."""
    n = len(media)
    if n <= LEAST:
        return [(0, n)]
    h, size = GEAR[np.frombuffer(media, np.uint8)], 1
    while size < 32:  # h[i] = sum of GEAR[byte i - k] << k
        h[size:] += h[:-size].copy() << np.uint32(size)
        size *= 2
    at = (np.flatnonzero(h < np.uint32(1 << (32 - MASK_BITS))) + 1).tolist()
    out, start, k = [], 0, 0
    while start < n:
        while k < len(at) and at[k] < start + LEAST:
            k += 1
        end = min(n, start + MOST, at[k] if k < len(at) else n)
        out.append((start, end))
        start = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature_of(samples: bytes) -> str:
    """Samples, mean, root mean square, sign changes about the mean, and the loudest and the most silent frame, of samples read as -128 to 127."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    changes = int((np.diff(np.signbit(x * n - total)) != 0).sum())
    frames = np.sqrt((x.reshape(-1, FRAME) ** 2).sum(axis=1) / FRAME)
    return f"samples={n};mean={total / n:.4f};rms={(square / n) ** 0.5:.4f};crossings={changes};loudest={int(frames.argmax())}:{frames.max():.4f};quietest={int(frames.argmin())}:{frames.min():.4f}"


def listed(rows: DataFrame) -> DataFrame:
    """task, __id, __hash, pos, digest of each chunk of rows of keyed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                row, pos, names = [], [], []
                for k, data in enumerate(b.column(2).to_pylist()):
                    media = media_of(data)
                    for p, (x, y) in enumerate(chunks_of(media)):
                        row.append(k)
                        pos.append(p)
                        names.append(digest(media[x:y]))
                taken = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(row), pa.int32()), b.column(0).take(taken), b.column(1).take(taken), pa.array(pos, pa.int32()), pa.array(names, pa.binary())], names=["task", "__id", "__hash", "pos", "digest"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"task int, __id {kind}, __hash long, pos int, digest binary")


def roles(rows: DataFrame, path: str) -> int:
    """Write for each file its chunks that others share (it owns them) and that are foreign; a folder for each task modulo the number returned."""
    parts = max(1, min(TABLES, rows.rdd.getNumPartitions()))
    found = listed(rows)
    owner = [F.first(c).alias(f"o_{c}") for c in ("__id", "__hash", "pos")]
    repeated = written(found.groupBy("digest").agg(F.count("*").alias("n"), *owner).where("n > 1").drop("n"), "repeated-chunks")
    own = F.col("__id").eqNullSafe(F.col("o___id")) & (F.col("__hash") == F.col("o___hash")) & (F.col("pos") == F.col("o_pos"))
    each = found.join(repeated, "digest").select("task", "__id", "__hash", "pos", own.alias("own")).distinct()
    per = each.groupBy("task", "__id", "__hash").agg(F.collect_list(F.when(F.col("own"), F.col("pos"))).alias("shared"), F.collect_list(F.when(~F.col("own"), F.col("pos"))).alias("foreign"))
    per.withColumn("part", F.pmod("task", F.lit(parts))).repartition("part").write.partitionBy("part").parquet(path)
    return parts


STORED = "__id {kind}, __hash long, n_bytes long, media_sha256 string, digests array<binary>, sizes array<int>, own binary, shared array<struct<pos:int,z:binary>>, foreign array<int>"


def stored(rows: DataFrame) -> DataFrame:
    """Write the files of rows of keyed(): a row for each, with the bytes of the chunks that it owns; chunks that others share are kept singly."""
    spark = rows.sparkSession
    path = scratch(spark, "chunk-roles")
    parts = roles(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        press = zstd.ZstdCompressor(level=6)
        task = TaskContext.get().partitionId()
        where, folder = opened(f"{path}/part={task % parts}")
        role: dict[tuple, tuple] = {}
        if where.get_file_info(folder).type.name == "Directory":
            found = parquet.read_table(folder, filesystem=where, partitioning=None, filters=[("task", "=", task)])
            role = {(r["__id"], r["__hash"]): (set(r["shared"]), set(r["foreign"])) for r in found.to_pylist()}
        missed = set(role)
        shared_type = pa.list_(pa.struct([("pos", pa.int32()), ("z", pa.binary())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for key, h, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    media = media_of(data)
                    cuts = chunks_of(media)
                    shared, foreign = role.get((key, h), ((), ()))
                    missed.discard((key, h))
                    own = b"".join(media[x:y] for p, (x, y) in enumerate(cuts) if p not in shared and p not in foreign)
                    out.append((len(data), hashlib.sha256(media).hexdigest(), [digest(media[x:y]) for x, y in cuts], [y - x for x, y in cuts], press.compress(own), [{"pos": p, "z": press.compress(media[slice(*cuts[p])])} for p in sorted(shared)], sorted(foreign)))
                kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), shared_type, pa.list_(pa.int32())]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["__id", "__hash", "n_bytes", "media_sha256", "digests", "sizes", "own", "shared", "foreign"])
        if missed:
            raise MediaError("the second pass saw other partitions than the first; write the rows before they are stored")

    kind = rows.schema["__id"].dataType.simpleString()
    return written(rows.mapInArrow(run, STORED.format(kind=kind)), "media")


def assembled(files: DataFrame, key: str) -> DataFrame:
    """The files, put together from their lists of chunks, verified, and described. files: the columns of stored() and got, array of struct pos, z."""
    kind = files.schema["__id"].dataType
    schema = StructType().add(key, kind).add("n_bytes", LongType()).add("media", BinaryType()).add("media_sha256", StringType()).add("feature", StringType()).add("n_chunks", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        press = zstd.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                ids, sizes, out, sha, features, counts = b.column(0), [], [], [], [], []
                for r in b.to_pylist():
                    other = {c["pos"]: c["z"] for c in [*(r["shared"] or ()), *(r["got"] or ())]}
                    own, at_own, parts = press.decompress(r["own"]), 0, []
                    for p, (name, size) in enumerate(zip(r["digests"], r["sizes"], strict=True)):
                        if p in other:
                            part = press.decompress(other[p])
                        else:
                            part = own[at_own : at_own + size]
                            at_own += size
                        if len(part) != size or digest(part) != name:
                            raise MediaError(f"chunk {p} of a file is not what its digest says")
                        parts.append(part)
                    media = b"".join(parts)
                    if hashlib.sha256(media).hexdigest() != r["media_sha256"]:
                        raise MediaError("a file is not what its digest says")
                    sizes.append(r["n_bytes"])
                    out.append(media)
                    sha.append(r["media_sha256"])
                    features.append(feature_of(samples_of(media)))
                    counts.append(len(parts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(out, pa.binary()), pa.array(sha), pa.array(features), pa.array(counts, pa.int32())], names=schema.names)

    return files.select("__id", "n_bytes", "media_sha256", "digests", "sizes", "own", "shared", "got").mapInArrow(run, schema)


def read_back(store: DataFrame, key: str) -> DataFrame:
    """key, n_bytes, media, media_sha256, feature, n_chunks of the files of a store; only files with foreign chunks are shuffled.

    A chunk that many files need is joined to their lists as a written table, so that its files are split among tasks.
    """
    none = F.lit(None).cast("array<struct<pos:int,z:binary>>")
    whole = store.where(F.size("foreign") == 0).withColumn("got", none)
    parted = store.where(F.size("foreign") > 0)
    chunks = store.select("digests", F.explode("shared").alias("c")).select(F.get("digests", F.col("c.pos")).alias("digest"), "c.z").dropDuplicates(["digest"])
    needed = parted.select("__id", "__hash", "digests", F.explode("foreign").alias("pos")).select("__id", "__hash", "pos", F.get("digests", F.col("pos")).alias("digest")).distinct()
    got = needed.join(written(chunks, "chunks"), "digest").groupBy("__id", "__hash").agg(F.collect_list(F.struct("pos", "z")).alias("got"))
    got = written(got, "chunk-lists").withColumnsRenamed({"__id": "__id2", "__hash": "__hash2"})
    parted = parted.join(got, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), "left").drop("__id2", "__hash2")
    return assembled(whole.unionByName(parted), key)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text in UTF-8), media (the file read back from the store), media_sha256, feature, n_chunks of each row.

    A null text is empty, and an empty text is a frame of spaces; rows of equal key and equal text share a list of chunks; null keys are kept; other columns are
    left aside; an empty table gives no rows. Equal texts have equal files.
    """
    return read_back(stored(keyed(docs, key, text)), key)
