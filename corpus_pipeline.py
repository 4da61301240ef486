"""From raw documents to a training mix: five operators, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and gives the rows it keeps, with the columns
of ``documents``; the last one gives what the mix takes of each document. Between
stages the rows are written and read again, so a lost executor costs one stage at most.
Null texts are empty; they go on through every stage that has nothing against them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, mixing, pii, setjoin
from veilframe.llm.common import read, staged
from veilframe.llm.queries import kept, quality_scores


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good, neither harmful nor poor."""
    scored = quality_scores(spark, docs, sf_dir)
    return scored.where(kept()).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; texts without words stay.

    Rows of one id whose texts are no copies each count for their own group. A row that is
    there twice, id and all, stays once; without words it stays as often as it is there,
    if it has no id.
    """
    first = setjoin.first_rows(docs).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "bare")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    own = F.when(F.col("bare") & F.col("doc_id").isNull(), F.monotonically_increasing_id())
    chosen = docs.join(first, same).withColumn("_own", own)
    return chosen.dropDuplicates(["doc_id", "_hash", "_own"]).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontaminate.without_items(docs, read(spark, sf_dir, "benchmark"))


def private_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    masked = pii.redacted(pii.find_pii(docs, "text", "_pii"), "text", "_pii")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("pii", private_data_masked),
    ("mixing", mixed_sources),
]

# The classifier's fit and the graph search have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
