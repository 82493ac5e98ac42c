"""The toxicity classifier on held-out rows, and the pipeline's stages against brute-force versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ringwork.llm import suffixes, toxicity
from ringwork.llm.queries import QUERIES
from test_repeats import brute_lines, covered
from test_similarity import brute_classes
from test_tokens import held
from tests_path import SF

MIDDLE, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def features(text):
    """Value by feature: the square root of its count among the text's words."""
    found = [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]
    names = Counter(f for w in found for f in (f"={w}", f"4^{w[:4]}", f"5^{w[:5]}", f"6^{w[:6]}"))
    hashed = Counter()
    for f, n in names.items():
        hashed[xxhash.xxh3_64_intdigest(f.encode()) % 2**17] += n
    return {f: (n / len(found)) ** 0.5 for f, n in hashed.items()}


def brute_scores(positive, unlabelled, prior, texts):
    """(scores of texts, steps that went the other way) of the non-negative risk over a dense matrix; its slopes are held against differences of the risk."""
    pos, unl = list(map(features, positive)), list(map(features, unlabelled))
    p, u, n, m = Counter(f for x in pos for f in x), Counter(f for x in unl for f in x), len(pos), len(unl)
    used = []
    for f in sorted(p.keys() | u.keys()):
        both = (p[f] + u[f]) / (n + m)
        if p[f] + u[f] >= 3 and both < 1 and abs(p[f] / n - u[f] / m) >= 4 * (both * (1 - both) * (1 / n + 1 / m)) ** 0.5:
            used.append(f)
    rare = np.log([(n + m) / (p[f] + u[f]) for f in used])
    matrix = lambda rows: np.array([[x.get(f, 0.0) for f in used] for x in rows]) * rare
    of_pos, of_unl = matrix(pos), matrix(unl)
    cost = lambda g: np.log1p(np.exp(-g))  # of taking g as positive

    def risks(shift):
        """The positives' risk and the corrected one of the negatives, at w and b, or with each weight shifted (and the bias last)."""
        gp, gu = of_pos @ w + b, of_unl @ w + b
        if shift:
            gp, gu = (np.column_stack([g[:, None] + shift * x, g + shift]) for g, x in ((gp, of_pos), (gu, of_unl)))
        return prior * cost(gp).mean(0), cost(-gu).mean(0) - prior * cost(-gp).mean(0)

    w, b, away = np.zeros(len(used)), np.log(prior / (1 - prior)), 0
    mean, square, eps = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 1e-4
    for step in range(1, 201):
        xp, xu = (np.column_stack([x, np.ones(len(x))]) for x in (of_pos, of_unl))
        sp, su = (1 / (1 + np.exp(-x @ np.append(w, b))) for x in (xp, xu))
        up, down = prior * xp.T @ (sp - 1) / n, xu.T @ su / m - prior * xp.T @ sp / n
        if step % 20 == 1:
            for slope, more, less in zip((up, down), risks(eps), risks(-eps), strict=True):
                assert np.allclose(slope, (more - less) / (2 * eps), rtol=0, atol=1e-7)
        below = risks(0)[1] < 0
        away += below
        slope = (-down if below else up + down) + 1e-5 * np.append(w, 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.6 * (1 - step / 201) * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return 1 / (1 + np.exp(-np.clip(matrix(map(features, texts)) @ w + b, -30, 30))), away


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id")
    return docs.select("doc_id", "text", "toxic").collect()


def test_held_out_accuracy(labelled):
    train = [r for r in labelled if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    test = [r for r in labelled if not zlib.crc32(str(r["doc_id"]).encode()) % 5]
    positive = [r["text"] for r in train if r["toxic"]]
    model = toxicity.train(positive, [r["text"] for r in train], len(positive) / len(train))
    score, toxic = model.score([r["text"] for r in test]), np.array([r["toxic"] for r in test])
    found = score >= 0.5
    assert (found & (toxic == 1)).sum() >= 0.85 * toxic.sum() and (found & (toxic == 0)).sum() <= 0.01 * len(test)
    order = np.argsort(np.argsort(score))
    assert (order[toxic == 1].mean() - (toxic.sum() - 1) / 2) / (len(test) - toxic.sum()) > 0.94


def test_training_against_brute_force():
    """Where the unlabelled hold positives too, and the prior is high enough for the corrected risk to fall below zero."""
    rng = np.random.default_rng(8)
    text = lambda bad: " ".join([*(f"word{i}" for i in rng.integers(0, 60, 25)), *(f"bad{i}" for i in rng.integers(0, 12, 5 * bad))])
    positive, unlabelled = [text(1) for _ in range(60)], [text(k % 4 == 0) for k in range(240)]
    turned = {}
    for prior in (0.1, 0.25, 0.5):
        texts = [*positive, *unlabelled, None, ""]
        want, turned[prior] = brute_scores(positive, unlabelled, prior, texts)
        assert np.abs(toxicity.train(positive, unlabelled, prior).score(texts) - want).max() < 1e-5, prior
    assert turned[0.5] > 0


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    seen = {k for k in docs if zlib.crc32(str(k).encode()) % 5}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    positive = [docs[k] for k, toxic in labels.items() if toxic and k in docs]
    want, _ = brute_scores(positive, [docs[k] for k in seen], sum(labels.values()) / len(labels), list(docs.values()))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op8_toxicity"](spark, MIDDLE).collect()}
    assert max(abs(got[k] - x) for k, x in zip(docs, want, strict=True)) < 1e-5


def test_scores(spark, docs, nothing):
    model = toxicity.train(["bad word here"] * 30, ["bad word here"] * 10 + [f"good text {k}" for k in range(200)], 0.05)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows) and toxicity.scored(nothing, model).collect() == []
    assert model.score(["bad"])[0] > 0.5 > model.score([None])[0] == model.score([""])[0]
    assert toxicity.train([], ["a"], 0.1).score(["a"])[0] < 0.5
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, empty).score(["a"])[0] < 0.5


def test_query(spark):
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, tmp_path):
    """Each stage takes what the one before wrote; its rows are those of a brute-force version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, texts_of(docs)
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "suffix_dedup", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name == "packing":
            pieces = out.collect()
            held(pieces, before)
            assert {r["doc_id"] for r in pieces} == set(before)
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = texts_of(docs)
        if name == "toxicity":
            want = {i: t for i, t in before.items() if not scores[i]}
        elif name == "line_dedup":
            want = brute_lines(before)
        elif name == "near_duplicates":
            want = {i: before[i] for i, (c, _) in brute_classes(before).items() if c == i}
        else:
            data = {i: (t or "").encode() for i, t in before.items()}
            want = {}
            for (i, d), on in zip(data.items(), covered(list(data.values()), suffixes.LENGTH), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
                for s, e in reversed(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))):
                    s, e = suffixes.whole_characters(d, s, e)
                    d = d[:s] + d[e:]
                want[i] = d.decode()
        assert after == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.select("text", "n_chars").collect())
        before = after


def test_one_row_of_each_class_where_keys_tie(spark):
    rng = np.random.default_rng(4)
    text = lambda n=120: " ".join(f"w{i}" for i in rng.integers(0, 9000, n))
    a, b, c, d = (text() for _ in range(4))
    rows = 3 * [(1, a)] + [(1, a + " more"), (2, a)]  # repeated rows; a near copy of the same key, and a copy
    rows += [(7, b), (7, c), (7, c + " end"), (8, b)]  # one key of two classes
    rows += [(None, d), (None, d), (9, d + " x"), (None, a)]
    rows += [(3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((repr(r["doc_id"]), r["text"] or "") for r in corpus_pipeline.near_stage(spark, docs, SF).collect())
    least = lambda x, y: {x, y} & {t for _, t in found}
    assert len(least(a, a + " more")) == 1 and len(least(c, c + " end")) == 1
    assert found == sorted([("1", *least(a, a + " more")), ("7", b), ("7", *least(c, c + " end")), ("9", d + " x"), ("3", ""), ("4", "")])


def test_a_repeated_row_stays_through_both_stages(spark):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.integers(0, 9000, 120))
    docs = spark.createDataFrame([(1, text, 0)] * 3 + [(2, "other", 0)], "doc_id long, text string, n_chars long")
    near = corpus_pipeline.near_stage(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.repeats_stage(spark, near, SF).collect()) == [(1, text), (2, "other")]


def test_awkward_rows_pass_every_stage(spark, tmp_path, docs):
    table = docs.select("doc_id", "text", "lang", docs["lang"].alias("source"), docs["n"].cast("long").alias("n_chars"), docs["__n"], docs["h"])
    for some in (table, table.where("false")):
        rows = some
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, SF)
            path = str(tmp_path / f"{k}-{some is table}")
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
        assert (rows.count() > 0) == (some is table)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
