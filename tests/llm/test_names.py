"""Columns that are called like those that operators add pass unchanged."""

import pytest

import corpus_pipeline
from ringwork.llm import jaccard, spans, suffixes, toxicity
from tests_path import SF

NAMES = ["__id", "__hash", "__spans", "__lines", "__kept", "__score", "__doc", "score", "c0", "c1", "found", "Text2", "a b.c"]
LINES = "one line here\ntwo lines here\nthree lines here\n"


@pytest.fixture(scope="module")
def named(spark):
    texts = [LINES * 30 + "end", LINES * 30 + "end", "other words are here. And these too, of which there are some. " * 9, "", None, "short"]
    rows = [(k, t, *[f"{n}{k}" for n in NAMES]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(2)


MODEL = toxicity.Model({}, -5.0)
OPERATORS = [spans.dedup_lines, spans.dedup_sentences, suffixes.without_repeats, jaccard.one_of_each, lambda df: toxicity.scored(df, MODEL, score="new").drop("new")]


@pytest.mark.parametrize("operator", OPERATORS)
def test_operators(operator, named):
    found = operator(named)
    assert found.columns == named.columns
    rows = found.collect()
    assert len(rows) == (named.count() if operator is not jaccard.one_of_each else 5)
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n}{r['doc_id']}" for n in NAMES]


def test_stages(named, spark):
    table = named.withColumnRenamed("found", "lang").withColumnRenamed("Text2", "source")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert [c for c in out.columns if c != "n_chars"] == table.columns
        for r in out.collect():
            assert [r[n] for n in NAMES[:9]] == [f"{n}{r['doc_id']}" for n in NAMES[:9]]
