"""What op2_quality and the pipeline's first stage keep, on labels that the fit has not seen."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import quality
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_harmful_and_poor_rows_go_and_good_ones_stay(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    labels.where(~held).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id", "left_semi").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    truth = {r.doc_id: "harm" if r.toxic else "good" if r.quality else "poor" for r in labels.where(held).collect()}
    keep = {r.doc_id: r.keep for r in QUERIES["op2_quality"](spark, str(tmp_path)).collect() if r.doc_id in truth}
    assert set(keep) == set(truth)
    share = {}
    for kind in ("harm", "poor", "good"):
        rows = [d for d, k in truth.items() if k == kind]
        assert len(rows) > 100
        share[kind] = sum(keep[d] for d in rows) / len(rows)
    assert share["harm"] <= 0.2 and share["poor"] <= 0.2 and share["good"] >= 0.95, share
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stayed = {r.doc_id for r in corpus_pipeline.good_documents(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert stayed & set(truth) == {d for d, k in keep.items() if k}


def test_a_fit_takes_little_more_memory_than_its_features(monkeypatch):
    """pipeline: features are gone through in pieces, with the same sums whatever their size."""
    dice = np.random.default_rng(5)
    n = 2_000_000
    row = np.repeat(np.arange(n // 100, dtype=np.int32), 100)
    bucket, value = dice.integers(0, 5_000, n).astype(np.int32), dice.random(n).astype(np.float32)
    grade = dice.integers(0, 3, n // 100)
    monkeypatch.setattr(quality, "ENTRIES", 10_000)
    tracemalloc.start()
    model = quality.fit_ordinal(row, bucket, value, grade, epochs=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * n
    monkeypatch.setattr(quality, "ENTRIES", n)
    whole = quality.fit_ordinal(row, bucket, value, grade, epochs=3)
    assert (model.weights == whole.weights).all() and (model.thresholds == whole.thresholds).all()
