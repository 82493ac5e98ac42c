"""Sentence, line and byte deduplication against SQL and brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from ringwork.llm import spans, suffixes
from ringwork.llm.oracles import ORACLES
from ringwork.llm.queries import QUERIES
from tests_path import SF


@pytest.mark.parametrize("name", list(ORACLES))
def test_agrees_with_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def brute_lines(texts):
    """Texts by key without the lines that later windows cover."""
    first, out = {}, {}
    for k in sorted(texts):
        lines = (texts[k] or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip() and first.setdefault(window, (k, i)) != (k, i):
                gone.update(range(i, i + 3))
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else texts[k]
    return out


def brute_sentences(texts):
    first, out = {}, {}
    for k in sorted(texts):
        t = texts[k] or ""
        gone = np.zeros(len(t), bool)
        for a, b, run in spans.runs_of(t) if t else ():
            if first.setdefault(run, (k, a)) != (k, a):
                gone[a:b] = True
        out[k] = "".join(c for c, g in zip(t, gone, strict=True) if not g) if gone.any() else texts[k]
    return out


@pytest.mark.parametrize(("operator", "brute"), [(spans.dedup_lines, brute_lines), (spans.dedup_sentences, brute_sentences)])
def test_spans(operator, brute, docs, unique, nothing):
    found = operator(docs, report="found")
    assert found.columns == [*docs.columns, "found"] and operator(docs).columns == docs.columns
    rows = found.collect()
    want = brute(unique)
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            assert r["text"] == want[r["doc_id"]] and (r["found"]["n_removed"] > 0) == (r["text"] != unique[r["doc_id"]])
        assert (r["lang"], r["__n"], r["start"], r["h"], r["n"]) == ("en", 1, 2, 3, 4)
    assert any(want[k] != unique[k] for k in unique) and operator(nothing, report="found").collect() == []


def test_windows_of_short_sentences(spark):
    rng = random.Random(12)
    parts = {k: [rng.choice(["Aa.", "Bb cc!", "Dé?", "E f.", "Gh."]) for _ in range(rng.randint(0, 14))] for k in range(30)}
    docs = spark.createDataFrame([(k, " ".join(p)) for k, p in parts.items()], "doc_id long, text string").repartition(3)
    first, want = {}, {}
    for k, p in parts.items():
        gone = set()
        for i in range(len(p) - 2):
            if first.setdefault(tuple(p[i : i + 3]), (k, i)) != (k, i):
                gone.update(range(i, i + 3))
        want[k] = "".join(x + (" " if i < len(p) - 1 else "") for i, x in enumerate(p) if i not in gone)
    assert {r["doc_id"]: r["text"] for r in spans.dedup_sentences(docs, window=3).collect()} == want


def covered(texts, length):
    """For each text of bytes, which bytes a repeated string covers."""
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        on = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                on[i : i + length] = True
        out.append(on)
    return out


def test_maximal_repeats_cover_what_repeats():
    rng = random.Random(2)
    for _ in range(150):
        length, letters = rng.choice([3, 5, 12, 20]), rng.choice([b"ab", b"abcd", b"a"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            texts.append(texts[0][5:40] + b"xyz" + texts[-1])
        got = [np.zeros(len(t), bool) for t in texts]
        for t, s, e in suffixes.covered_parts(texts, [(k, 0) for k in range(len(texts))], length):
            got[t][s:e] = True
        assert all((a == b).all() for a, b in zip(got, covered(texts, length), strict=True))


def test_groups_hold_all_occurrences():
    texts = [b"xxabcdefghyy", b"zabcdefghw", b"abcdefgh", b"qabcdeq"]
    groups = {(size, tuple(sorted(found))) for size, found in suffixes.repeats(texts, [(k, 0) for k in range(4)], 5)}
    assert groups == {(8, ((0, 2), (1, 1), (2, 0))), (5, ((0, 2), (1, 1), (2, 0), (3, 1)))}


def test_parts_of_one_place_are_no_repeats():
    assert suffixes.covered_parts([b"abcdefgh", b"cdefghij"], [(0, 0), (0, 2)], 5) == []


def peak_mb(made):
    tracemalloc.start()
    out = made()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_anchors_of_long_texts_take_little_memory():
    data = np.random.RandomState(3).randint(97, 123, 1 << 21).astype(np.uint8)
    ends = np.array([5, 1 << 20, (1 << 20) + 100, 1 << 21])
    found, peak = peak_mb(lambda: suffixes.anchors(data, ends))
    assert peak < 25  # hashes of all places at once take over 60 MB
    hashes = suffixes.TABLE[data]
    for size in (1, 2, 4, 8, 16, 32):
        hashes = hashes[:-size] * np.uint32(2654435761 + 2 * size) + (hashes[size:] ^ (hashes[size:] >> np.uint32(15)))
    inside = [(5, 1 << 20), ((1 << 20) + 100, 1 << 21)]
    for a, b in [(x, x + 3000) for x, _ in inside] + [(y - 3000, y) for _, y in inside] + [(suffixes.PIECE - 1500, suffixes.PIECE + 1500)]:
        want = {s + int(hashes[s : s + suffixes.LENGTH - suffixes.GRAM + 1].argmin()) for s in range(a, b - suffixes.LENGTH + 1)}
        assert want <= set(found.tolist()) and {f for f in found.tolist() if a + 200 <= f < b - 400} <= want


def test_arrays_of_large_groups_take_little_memory():
    rng = random.Random(5)
    common = bytes(rng.choices(b"abcdefgh", k=230))
    texts = [bytes(rng.choices(b"abcdefgh", k=50)) + common + bytes(rng.choices(b"abcdefgh", k=56)) for _ in range(8192)]
    parts, peak = peak_mb(lambda: suffixes.covered_parts(texts, [(k, 0) for k in range(len(texts))]))
    assert peak < 70  # it was over 110 MB
    assert [t for t, _, _ in parts] == list(range(8192)) and all(s <= 50 and e >= 280 for _, s, e in parts)


def test_contexts_are_cut_once(spark):
    texts = {0: "né" * 300 + "z" * 400, 1: "x" * 250, None: "y" * 300}
    docs = suffixes.keyed(spark.createDataFrame([*texts.items(), *3 * [(0, texts[0])], (0, "w" * 500)], "doc_id long, text string").repartition(3), "doc_id", "text")
    names = {r["__bytes"]: r["__hash"] for r in docs.collect()}
    reps = [(10 * k + i, 1, k, names[t.encode()], lo, lo + 200, 7) for k, t in ((0, texts[0]), (1, texts[1])) for i, lo in enumerate((0, 1, 50))]
    reps += [(99, 2, None, names[texts[None].encode()], 90, 300, 5), (98, 2, 0, names[b"w" * 500], 3, 9, 5)]
    schema = "g long, n long, __id long, __hash long, lo int, hi int, off int"
    found = suffixes.contexts(spark.createDataFrame(reps, schema).repartition(2), docs)
    assert found.columns == [*(x.split()[0] for x in schema.split(", ")), "ctx"]
    rows = sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])
    whole = {h: b for b, h in names.items()}
    assert rows == [(*r, whole[r[3]][r[4] : r[5]]) for r in sorted(reps)]  # a context came once for each repeated row


def check_bytes(found, texts):
    keys = list(texts)
    data = [(texts[k] or "").encode() for k in keys]
    want = dict(zip(keys, zip(data, covered(data, suffixes.LENGTH), strict=True), strict=True))
    for k, n, n_removed, kept in found:
        if k is not None:
            d, on = want[k]
            assert (n, n_removed, kept) == (len(d), int(on.sum()), bytes(np.frombuffer(d, np.uint8)[~on])), k


@pytest.mark.parametrize("group", [16384, 3])
def test_bytes(group, docs, unique, nothing, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = suffixes.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    check_bytes([(r["doc_id"], r["n_bytes"], sum(s["e"] - s["s"] for s in r["spans"]), bytes(r["kept"])) for r in rows], unique)
    assert suffixes.remove_repeats(nothing).collect() == []


@pytest.mark.parametrize("group", [16384, 1])
def test_repeated_rows_are_one_document(group, spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(9)
    alone, shared, *rest = ("".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(5))
    texts = {0: alone, 1: shared + rest[0], 2: rest[1] + shared, 3: rest[2]}
    rows = list(texts.items()) + 3 * [(0, alone)] + 2 * [(1, texts[1])] + 2 * [(None, rest[2][:100] + alone[:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffixes.remove_repeats(docs).collect()
    assert len(out) == len(rows)
    check_bytes([(r["doc_id"], r["n_bytes"], sum(s["e"] - s["s"] for s in r["spans"]), bytes(r["kept"])) for r in out], texts)
    kept = suffixes.without_repeats(docs).where("doc_id = 0").collect()
    assert [r["text"] for r in kept] == 4 * [alone]


def test_texts_without_repeats(docs, unique):
    rows = suffixes.without_repeats(docs).collect()
    data = {r["doc_id"]: r["text"] for r in rows}
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeats(docs).collect()}
    assert len(rows) == docs.count() and data[0] is None
    for k, t in unique.items():
        if t and t.isascii():
            assert data[k].encode() == kept[k]
        assert (data[k] == t) == (kept[k] == (t or "").encode())


def test_byte_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keys = list(texts)
    data = [(texts[k] or "").encode() for k in keys]
    want = {k: (len(d), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~on].tobytes()).hexdigest()) for k, d, on in zip(keys, data, covered(data, 200), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op10_suffix_dedup"](spark, SF).collect()} == want
