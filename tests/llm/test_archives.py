"""WARC archives and media: round trips, checks of what is read, edge cases."""

import base64
import hashlib
import struct
import zlib

import pytest
import zstandard as zstd

from ringwork.llm import media, warc
from ringwork.llm.queries import QUERIES
from tests_path import SF


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a b/", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 9), (5, "u", "é" * 9), (None, "u", "x"), (None, "u", "alone")], "page_id long, url string, html string")
    rows = warc.archive_pages(pages.withColumn("payload", pages["html"])).collect()
    got = sorted((r["record_id"] or "", r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    assert got == [("", "response", None, 5), ("", "revisit", "2", 1), ("1", "revisit", "2", 1), ("2", "response", None, 1), ("3", "revisit", "4", 0), ("4", "response", None, 0), ("5", "response", None, 18), ("5", "response", None, 18)]
    digest = {r["record_id"]: r["payload_digest"] for r in rows}
    assert digest["5"] == base64.b32encode(hashlib.sha1(("é" * 9).encode()).digest()).decode()
    assert warc.archive_pages(pages.where("false")).collect() == []


def archive(tmp_path, records):
    path = str(tmp_path / "a.warc.zst")
    w = warc.Writer(path)
    for r in records:
        w.add(r)
    w.close()
    return path


def test_archive_is_a_dictionary_and_a_frame_for_each_record(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    records = [warc.record(k, f"http://x/{k}", (f"<p>page {k}</p>" * (k % 40)).encode(), None) for k in range(300)]
    path = archive(tmp_path, records)
    assert list(warc.frames(path)) == records
    data = open(path, "rb").read()
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE and data.count(struct.pack("<I", warc.FRAME)) >= 301
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    assert list(warc.frames(path)) == records
    assert warc.parsed(records[7])[0]["warc-target-uri"] == "http://x/7"


def test_broken_archives(tmp_path):
    path = archive(tmp_path, [warc.record(1, "u", b"payload", None)])
    data = open(path, "rb").read()
    for broken in (data[8:], data[:-3], data[:6], data[:20], data + b"rubbish"):
        open(path, "wb").write(broken)
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(path))
    frame = zstd.ZstdCompressor(write_content_size=False).compressobj()
    unsized = frame.compress(b"words of a dictionary " * 9) + frame.flush()
    open(path, "wb").write(struct.pack("<II", warc.SKIPPABLE, len(unsized)) + unsized)
    assert list(warc.frames(path)) == []
    open(path, "wb").write(struct.pack("<II", warc.SKIPPABLE, len(unsized) - 9) + unsized[:-9])
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(path))
    revisit = warc.record(1, "u", b"payload", 2)
    for broken in (revisit.replace(b"X-Payload-Length: 7", b"X-Payload-Length: x"), revisit.replace(b"X-Payload-Length", b"X-Other-Length"), revisit.replace(b"URI: u", b"URI: \xff")):
        with pytest.raises(warc.ArchiveError):
            warc.parsed(broken)
    good = warc.record(1, "u", b"payload", None)
    for broken in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"payload\r", b"Payload\r"), good.replace(b"WARC-Date", b"Other-Date"), good[:-2], good.replace(b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(warc.ArchiveError):
            warc.parsed(broken)


def test_raw_dictionary_and_empty_payload(tmp_path):
    path = archive(tmp_path, [warc.record(None, None, b"", 5)])
    headers, block = warc.parsed(next(iter(warc.frames(path))))
    assert block == b"" and headers["warc-refers-to"] == "<urn:page:5>"
    assert zstd.frame_content_size(open(path, "rb").read()[8 + struct.unpack("<II", open(path, "rb").read()[:8])[1] :]) > 0


def brute_cuts(data):
    """The chunks by a rolling hash, byte by byte."""
    out, start, h = [], 0, 0
    for k, b in enumerate(data):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        n = k + 1 - start
        if n >= media.LEAST and h >> (32 - media.MASK_BITS) == 0 or n == media.MOST:
            out.append((start, k + 1))
            start = k + 1
    return out + [(start, len(data))] * (start < len(data))


def test_chunks():
    data = b"".join(hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(4000))
    cuts = media.chunks_of(data)
    assert cuts == brute_cuts(data) and media.chunks_of(b"x" * 40_000) == brute_cuts(b"x" * 40_000)
    moved = media.chunks_of(b"inserted" + data)
    assert len({(data[a:b]) for a, b in cuts} & {(b"inserted" + data)[a:b] for a, b in moved}) > len(cuts) * 0.8


def expected(text):
    data = (text or "").encode()
    payload = data + b" " * (-len(data) % 192) if data else b" " * 192
    return len(data), payload


def test_media(docs, unique, nothing):
    rows = media.media_columns(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            n, payload = expected(unique[r["doc_id"]])
            assert (r["n_bytes"], media.samples_of(bytes(r["media"]))) == (n, payload) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
            assert r["feature"] == media.feature_of(payload)
    assert media.media_columns(nothing).collect() == []


def test_chunks_are_stored_once(docs):
    store = media.stored(media.keyed(docs.dropDuplicates(["doc_id", "text"]), "doc_id", "text")).collect()
    owned = [d for r in store for p, d in enumerate(r["digests"]) if p not in r["foreign"]]
    assert len(owned) == len(set(owned)) == len({d for r in store for d in r["digests"]}) and any(r["foreign"] for r in store)


def test_damage_is_seen(spark, docs):
    from pyspark.sql import functions as F

    store = media.stored(media.keyed(docs, "doc_id", "text"))
    with pytest.raises(Exception, match="MediaError"):
        media.read_back(store.withColumn("media_sha256", F.lit("0")), "doc_id").collect()
    with pytest.raises(media.MediaError):
        media.samples_of(media.media_of(b"abc")[:-1])


def test_media_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op6_media"](spark, SF).collect():
        n, payload = expected(texts[r["doc_id"]])
        stored = media.media_of((texts[r["doc_id"]] or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(payload))
