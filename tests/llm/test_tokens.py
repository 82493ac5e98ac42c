"""BPE encoding and packing against the library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwork.llm import bpe, packing
from ringwork.llm.queries import QUERIES, tokenizer_path
from tests_path import SF

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz", "the", "!?.,", "é̈aΣİ日本語x", "'s!1a", "aB.,", "aΣİ.b, .", " a.\n,1", "a \xa0\x1c\x85 b"]


def mixed(rng):
    s = "".join(rng.choice(rng.choice(ALPHABETS)) if rng.random() < 0.1 else rng.choice(ALPHABETS[rng.randrange(len(ALPHABETS))]) for _ in range(rng.randint(0, 40)))
    a = rng.choice(ALPHABETS)
    s += "".join(rng.choice(a) for _ in range(rng.choice([5, 50, 1500])))
    return s[:20] + rng.choice(["", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "  ", "\n"]) + s[20:]


@pytest.mark.parametrize("leaf", [8, 64, 1024])
def test_tree_concatenation_is_exact(leaf):
    rng, tok = random.Random(leaf), bpe.tokenizer(WORD)
    texts = [mixed(rng) for _ in range(150)] + ["", None, "x" * 9000, "lo" * 3000]
    ids, at = bpe.Encoder(WORD, leaf).encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_texts_are_joined(spark):
    """Whole texts of the table go up the tree, with leaves as in the query, and a small table of units changes nothing."""
    tok = bpe.tokenizer(WORD)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for leaf, limit in ((bpe.LEAF, bpe.LIMIT), (100, 10_000)):
        encoder = bpe.Encoder(WORD, leaf, limit)
        assert encoder.known_form
        for k in range(0, len(texts), 20):
            ids, at = encoder.encode(texts[k : k + 20])
            for j, t in enumerate(texts[k : k + 20]):
                assert ids[at[j] : at[j + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids
        assert encoder.joins > 0 and (leaf > 100 or encoder.joins > len(texts))


def test_other_tokenizers_encode_whole_texts():
    encoder = bpe.Encoder(BYTE)
    ids, at = encoder.encode(["a b  c\n" * 3000, None])
    assert not encoder.known_form and ids.tolist() == bpe.tokenizer(BYTE).encode("a b  c\n" * 3000, add_special_tokens=False).ids and at.tolist() == [0, len(ids), len(ids)]


def test_byte_encoder_is_exact():
    rng, tok = random.Random(3), bpe.tokenizer(BYTE)
    texts = [mixed(rng) for _ in range(300)] + ["", "x" * 3000, "a. b, c", "a\n\nb", "a.\nB", "\na "]
    assert packing.ByteEncoder(BYTE).encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


class Counted(dict):
    asked = 0

    def __getitem__(self, key):
        Counted.asked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        Counted.asked += 1
        return super().get(key, default)


def test_known_units_are_looked_up_once_in_a_call():
    encoder, texts = packing.ByteEncoder(BYTE), ["the house of the end, of the\n" * 500 + "end"] * 4
    want = encoder.encode(texts)
    encoder.held.now = Counted(encoder.held.now)
    Counted.asked = 0
    assert encoder.encode(texts) == want and Counted.asked < 50  # there are 16,000 units, of 8 kinds


def test_byte_encoder_with_small_table():
    rng, tok = random.Random(4), bpe.tokenizer(BYTE)
    texts = [None, "", "é" * 300 + " b", " x  y\n", "a\x1cb", "a\x01b", "a<|endoftext|>b", *(mixed(rng) for _ in range(200))]
    encoder = packing.ByteEncoder(BYTE, 2000)
    for k in range(0, len(texts), 9):
        assert encoder.encode(texts[k : k + 9]) == [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts[k : k + 9]]
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]


def test_codec(docs, unique, nothing):
    tok = bpe.tokenizer(WORD)
    rows = bpe.encode_decode(docs, WORD).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            ids = tok.encode(unique[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == ids and r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(nothing, WORD).collect() == []


def test_codec_query(spark):
    import hashlib

    tok = bpe.tokenizer(WORD)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe_codec"](spark, SF).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_division():
    rng = random.Random(1)
    for _ in range(50):
        lengths, windows = [rng.randint(1, 256) for _ in range(rng.randint(1, 90))], rng.randint(1, 12)
        parts = packing.divide(lengths, windows)
        assert sorted(k for p in parts for k in p) == list(range(len(lengths))) and len(parts) <= windows
        if len(lengths) > 6 * windows:
            sums = [sum(lengths[k] for k in p) for p in parts]
            assert max(sums) - min(sums) < 150
        assert all(sum(lengths[k] for k in p) <= 256 for p in packing.windows_for(lengths, 256))


def held(pieces, texts, copies=1):
    tok = bpe.tokenizer(BYTE)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for k, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        rows = sorted(by_doc[k], key=lambda r: r["start"])
        if sum(r["length"] for r in rows) == len(ids) // 4:
            assert b"".join(bytes(r["ids"]) for r in rows) == ids and all(r["doc_tokens"] == len(ids) // 4 for r in rows)
        else:  # a repeated row is packed twice
            assert sum(r["length"] for r in rows) == 2 * len(ids) // 4
    for rows in by_sequence.values():
        end = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
    return sum(r["length"] for r in pieces) / (1024 * len(by_sequence))


def test_packing(docs, unique, nothing):
    held(packing.pack(docs, BYTE).collect(), unique)
    assert packing.pack(nothing, BYTE).collect() == []


def test_packing_query(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(documents, BYTE)
    filled = held(pieces.collect(), {r["doc_id"]: r["text"] for r in documents.collect()})
    assert filled > 0.95
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in QUERIES["op3_packing"](spark, SF).collect()}
    assert digests == {(r["doc_id"], r["start"]): r["c"] for r in pieces.withColumn("c", F.crc32("ids")).collect()}
