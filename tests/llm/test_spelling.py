"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import pytest

from veilframe.llm import spelling
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def grouped(counts: dict) -> dict:
    """word: (form, root, n, n_near, form_n), by comparing every two words."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def counted(docs) -> dict:
    counts = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d.doc_id is None else d.doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def found(df) -> dict:
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert found(QUERIES["op11_spelling"](spark, SF)) == grouped(counted(docs))


WORDS = {
    "aabbcc": 5, "abbcc": 30, "aabbc": 30, "aaabbcc": 200, "éabbcc": 7, "÷abbcc": 7, "a": 9, "": 5, "b": 90,
    "abc" * 40: 5, "abc" * 40 + "d": 50, "abc" * 39 + "abd": 250, "zzzz": 5, "zzz": 5, "zz": 5,
}


@pytest.mark.parametrize("partitions", [1, 7])
def test_repeated_letters_long_words_and_ties(spark, partitions):
    words = spark.createDataFrame([(w, n, 1) for w, n in WORDS.items()], "word string, n long, prefix int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(spelling.variants(words.select("word", "n"))) == grouped(WORDS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_chains_end_at_the_most_frequent(spark):
    """Eleven steps: a, ab, abc, ... each five times as frequent."""
    words = {"abcdefghijkl"[: i + 1]: 5**i for i in range(12)}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words)
    assert got["ab"][1] == "abcdefghijkl"


def test_groups_over_batches(spark):
    """A prefix whose words lie in several Arrow batches is one group."""
    words = {f"{a}bcdef": 5 + i for i, a in enumerate("abcdefghijklmnopqrstuvwxyz")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == grouped(words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    schema = "doc_id long, text string, word string, n int, prefix int"
    assert spelling.report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "Straße straße STRAßE"), (1, "Straße straße STRAßE"), (None, "strasse " * 40 + "x" * 9_000), (2, None), (3, "")]
    rows += [(4, "naïveté " * 30), (5, "12 ab cd"), (6, ("naïvetés " + "y" * 3_000 + " ") * 6)]
    docs = spark.createDataFrame([(*r, "w", 1, 1) for r in rows], schema)
    assert found(spelling.report(docs)) == grouped(counted(docs.collect()))
