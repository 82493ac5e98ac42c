"""WARC archives of Zstandard frames: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame that holds the dictionary (itself a Zstandard frame); then each record is one frame made with that
dictionary, so a reader holds one record at a time. Records of equal payloads are stored once, as a response; the others are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ringwork.runtime import scratch, written

SKIPPABLE = 0x184D2A5D  # the magic number of a dictionary's frame
FRAME = 0xFD2FB528  # that of a frame of data
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond this size
SAMPLE_BYTES = 2 << 20  # of the first records, to train an archive's dictionary
DICTIONARY_BYTES = 64 << 10
READ_BYTES = 1 << 18
RECORD_BYTES = (1 << 31) - 1  # a larger record fits in no column: it raises ArchiveError, and is neither cut nor left out
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that is not what its frames or headers say."""


def sha1_name(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, response_of) -> bytes:
    """One WARC record; a revisit if response_of is not None."""
    block = b"" if response_of is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response_of is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{sha1_name(payload)}", f"WARC-Block-Digest: sha1:{sha1_name(block)}", f"X-Payload-Length: {len(payload)}"]
    if response_of is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response_of}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Writer:
    """Writes records to one archive; the first SAMPLE_BYTES wait until the dictionary is trained on them."""

    def __init__(self, path: str):
        self.path, self.held, self.size, self.records, self.out = path, [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        self.size += len(data)
        if self.out is None:
            self.held.append(data)
            if self.size >= SAMPLE_BYTES:
                self.begin()
        else:
            self.out.write(self.packer.compress(data))

    def begin(self) -> None:
        import zstandard as zstd

        try:
            trained = zstd.train_dictionary(DICTIONARY_BYTES, self.held)
        except zstd.ZstdError:  # too few or too small samples
            trained = zstd.ZstdCompressionDict(b"".join(self.held)[:DICTIONARY_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        frame = zstd.ZstdCompressor().compress(trained.as_bytes())
        where, name = opened(self.path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(name, compression=None)
        self.out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
        self.packer = zstd.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
        for data in self.held:
            self.out.write(self.packer.compress(data))
        self.held = []

    def close(self) -> None:
        if self.out is None:
            self.begin()
        self.out.close()


def frames(path: str) -> Iterator[bytes]:
    """The records of an archive, one decoded frame after another."""
    import zstandard as zstd

    where, name = opened(path)
    with where.open_input_stream(name, compression=None) as source:
        head = source.read(8)
        if len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE:
            raise ArchiveError(f"{path}: no dictionary frame at its start")
        size = struct.unpack("<II", head)[1]
        kept = source.read(size)
        if len(kept) != size:
            raise ArchiveError(f"{path}: the dictionary frame is cut short")
        if len(kept) >= 4 and struct.unpack("<I", kept[:4])[0] == FRAME:
            whole, found, at = zstd.ZstdDecompressor().decompressobj(), bytearray(), 0
            try:  # in pieces, so that the frame need not give its size
                while at < size and not whole.eof and len(found) <= RECORD_BYTES:
                    found += whole.decompress(kept[at : at + READ_BYTES])
                    at += READ_BYTES
            except zstd.ZstdError as e:
                raise ArchiveError(f"{path}: the dictionary: {e}") from e
            if not whole.eof:
                raise ArchiveError(f"{path}: the dictionary is cut short or has more than {RECORD_BYTES} bytes")
            kept = bytes(found)
        unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(kept))
        rest, one, out, size = b"", unpacker.decompressobj(), [], 0
        while True:
            data = rest or source.read(READ_BYTES)
            if not data:
                break
            if len(data) >= 4 and not out and struct.unpack("<I", data[:4])[0] != FRAME:
                raise ArchiveError(f"{path}: neither a frame nor the end")
            try:
                out.append(one.decompress(data))
            except zstd.ZstdError as e:
                raise ArchiveError(f"{path}: {e}") from e
            rest = b""
            size += len(out[-1])
            if size > RECORD_BYTES:
                raise ArchiveError(f"{path}: a record of more than {RECORD_BYTES} bytes")
            if one.eof:
                yield b"".join(out)
                rest, out, one, size = one.unused_data, [], unpacker.decompressobj(), 0
                if 0 < len(rest) < 4:
                    rest += source.read(READ_BYTES)
        if out:
            raise ArchiveError(f"{path}: the last frame is cut short")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; ArchiveError where they disagree."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise ArchiveError(f"headers that are not UTF-8: {e}") from e
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError(f"not a WARC record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise ArchiveError(f"not a header: {line[:40]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"a record without {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{headers['warc-record-id']}: the block is not of the length that its header gives")
    block = rest[:-4]
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{sha1_name(block)}":
        raise ArchiveError(f"{headers['warc-record-id']}: the block's digest differs")
    if headers["warc-type"] == "response":
        if (want := headers.get("warc-payload-digest")) and want != f"sha1:{sha1_name(block)}":
            raise ArchiveError(f"{headers['warc-record-id']}: the payload's digest differs")
    elif headers["warc-type"] == "revisit":
        if not re.fullmatch("[0-9]+", headers.get("x-payload-length", "")):
            raise ArchiveError(f"{headers['warc-record-id']}: a revisit without its payload's length")
        if not all(k in headers for k in ("warc-refers-to", "warc-payload-digest", "warc-profile")):
            raise ArchiveError(f"{headers['warc-record-id']}: a revisit of nothing")
    return headers, block


def classified(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """__id, __url, __payload (binary) and __refers (the response's id for revisits, null for responses).

    Of equal payloads the largest id is the response (each of its rows, if that row is repeated; a null id is the smallest, and rows
    with null ids alone are all responses). Payloads are compared by SHA-256. The ids of repeated payloads are aggregated before they are shuffled
    and joined back as a written table, so that a payload with many copies is split among tasks.
    """
    rows = pages.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{url}`").alias("__url"), F.coalesce(F.encode(F.col(f"`{payload}`"), "UTF-8"), F.lit(b"")).alias("__payload"))
    rows = rows.withColumn("__digest", F.sha2("__payload", 256))
    repeated = rows.groupBy("__digest").agg(F.max("__id").alias("__response"), F.count("*").alias("n")).where("n > 1").select("__digest", "__response")
    joined = rows.join(written(repeated, "payloads"), "__digest", "left")
    refers = F.when(~F.col("__id").eqNullSafe(F.col("__response")), F.col("__response"))
    return joined.select("__id", "__url", "__payload", refers.alias("__refers"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows of classified() as archives in a folder that all executors share; path, records and bytes of each.

    A task writes its archives under names of its own attempt; only those of attempts that succeeded are in the table, which is
    written before it is returned, so that the archives are written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, writer = TaskContext.get(), [], None

        def close() -> None:
            writer.close()
            made.append((writer.path, writer.records, writer.size))

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                for x in whole.slice(at, 64).to_pylist():
                    if writer is None:
                        writer = Writer(f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.zst")
                    writer.add(record(x["__id"], x["__url"], x["__payload"], x["__refers"]))
                    if writer.size >= ARCHIVE_BYTES:
                        close()
                        writer = None
        if writer is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "records", "bytes"])

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


READ = StructType().add("record_id", StringType()).add("url", StringType()).add("record_type", StringType()).add("refers_to", StringType()).add("payload_bytes", LongType()).add("payload_digest", StringType()).add("payload", "binary")


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in column path: record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Each task streams its archives frame by frame. An archive or record that breaks the format, or whose lengths or digests disagree, raises
    ArchiveError. A revisit has the digest and length of its payload, no payload; a record without a payload digest gets its block's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in READ if with_payload or f.name != "payload"]
        held, size = [], 0

        def out() -> pa.RecordBatch:
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=False)], names=names)
            held.clear()
            return made

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for data in frames(path):
                    h, block = parsed(data)
                    urn = re.compile(r"<urn:page:(.*)>")
                    own = urn.fullmatch(h["warc-record-id"])
                    refers = urn.fullmatch(h.get("warc-refers-to", ""))
                    length = int(h["x-payload-length"]) if h["warc-type"] == "revisit" else len(block)
                    digest = h.get("warc-payload-digest", f"sha1:{sha1_name(block)}").removeprefix("sha1:")
                    row = (own[1] or None if own else h["warc-record-id"], h.get("warc-target-uri"), h["warc-type"], refers[1] if refers else None, length, digest, block)
                    held.append(row if with_payload else row[:-1])
                    size += len(block) * with_payload
                    if len(held) >= 1000 or size >= 16 << 20:
                        size = 0
                        yield out()
        if held:
            yield out()

    schema = StructType([f for f in READ if with_payload or f.name != "payload"])
    return paths.select("path").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", folder: str | None = None) -> DataFrame:
    """Write one record per row to archives and read them back: the columns of read_archives(), without payloads.

    A null payload is empty; empty payloads are equal like others. Extra columns are left aside; an empty table makes no archive and no
    row. A null url leaves out its header.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    made = write_archives(classified(pages, key, payload, url), folder)
    n = max(1, made.count())  # one task for an archive
    return read_archives(made.repartition(min(n, 100_000)), with_payload=False)
