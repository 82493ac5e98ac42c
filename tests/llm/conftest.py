from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, score double, __n int, start long, h long, n int, label int"


def words(rng: random.Random, n: int) -> str:
    syllables = ["ka", "lo", "mi", "tu", "re", "sha", "né", "ö", "zu", "ba"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with null, empty, blank and very long ones, exact and near copies, shared passages, ties."""
    rng = random.Random(5)
    passage = ". ".join(words(rng, 14) for _ in range(6)) + ". "
    out = [None, "", " \n \n ", "a", "word", "日本語のテキスト " * 60, words(rng, 6000), "x" * 5000, "né" * 3000]
    base = [". ".join(words(rng, rng.randint(2, 12)) for _ in range(rng.randint(1, 20))) + ".\n" + "\n".join(words(rng, 6) for _ in range(rng.randint(0, 8))) for _ in range(25)]
    out += base + base[:6] + [t.replace(" ", "  ", 1) for t in base[:2]]
    for t in base[6:12]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [words(rng, 12) + ". " + passage + words(rng, 9) + "." for _ in range(5)]
    out += ["\n".join(["one line", "two lines", "three lines", words(rng, 4)]) for _ in range(4)]
    out += ["the the the " * 200, "the the the " * 150]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, with a repeated row, a null key, and columns named like those that operators use."""
    rows = [(k, t, "en", 0.5, 1, 2, 3, 4, 5) for k, t in enumerate(texts)]
    rows += [rows[12], (None, "a text whose key is null and that has more than five words", "en", 0.5, 1, 2, 3, 4, 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def unique(docs):
    """The rows with a key, each once, by key."""
    return {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
