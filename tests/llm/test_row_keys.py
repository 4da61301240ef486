"""Stages of the pipeline on rows whose ids repeat or are null."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
A = "a first text with words of its own that nobody else has"
B = "some other thing that was written down under a number taken before"
C = "a third one, without any number, which stands here more than once"


@pytest.fixture(scope="module")
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_each_row_is_judged_by_its_own_text(spark, docs):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    rows = [(None, passage), (None, A), (None, None), (1, passage), (1, B), (2, "x " + passage)]
    found = corpus_pipeline.without_benchmarks(spark, docs(rows), SF)
    assert texts(found) == sorted([(None, A), (None, None), (1, B)], key=str)


def test_one_row_of_each_group_whatever_the_ids(spark, docs):
    rows = [(1, A), (1, A), (1, B), (2, B), (3, A), (None, A), (None, C), (None, C), (None, ""), (None, ""), (4, "")]
    found = corpus_pipeline.one_of_each_group(spark, docs(rows), SF)
    assert texts(found) == sorted([(1, A), (1, B), (None, C), (None, ""), (None, ""), (4, "")], key=str)
