"""Fingerprints against the similarity that they estimate."""

import hashlib
from collections import Counter

import brute
from pyspark.sql import functions as F

from veilframe.llm import fingerprints
from veilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def alike(a: str, b: str) -> float:
    """Generalised Jaccard similarity of two bags of words."""
    a, b = (Counter(brute.SPACED.findall(t.lower())) for t in (a, b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_query_against_plain_python(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: -d.doc_id)
    got = {r.doc_id: r for r in QUERIES["op13_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    off, prints = [], {}
    for d, after in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(d.text)
        edited = d.text[: n - n // 2] + after.text[: n // 2]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(d.text, r.fingerprint) == r.fingerprint
        off += [r.near_edited - alike(d.text, edited), r.near_next - alike(d.text, after.text)]
        same = [x == y for x, y in zip(*(split(p) for p in (r.fingerprint, r.edited_fingerprint)), strict=True)]
        assert r.near_edited == sum(same) / len(same)
    # Standard error of 64 samples: at most 0.0625 for one text, far less over all.
    assert max(map(abs, off)) < 0.3 and abs(sum(off) / len(off)) < 0.02


def split(p: str) -> list[str]:
    return [p[i : i + 4] for i in range(0, len(p), 4)]


def test_collisions_follow_the_weights(spark):
    """Weights of 1.5, 3 and 0.25 against 3, 1 and 0.25: 2.75 over 6.25."""
    a, b = {1: 1.5, 2: 3.0, 3: 0.25}, {1: 3.0, 2: 1.0, 4: 0.25, 3: 0.25}
    rows = [(trial, side, 10 * trial + t, w) for trial in range(200) for side, bag in (("a", a), ("b", b)) for t, w in bag.items()]
    terms = spark.createDataFrame(rows, "trial int, side string, term long, weight double")
    found = fingerprints.weighted_samples(terms, ["trial", "side"]).groupBy("trial").pivot("side", ["a", "b"]).agg(F.first("fingerprint"))
    share = found.select(F.avg(fingerprints.likeness(F.col("a"), F.col("b")))).first()[0]
    assert abs(share - 2.75 / 6.5) < 0.02


def test_edges(spark):
    schema = "doc_id long, text string, _id int, _hash int, n_chars int"
    assert fingerprints.fingerprints_of_edits(spark.createDataFrame([], schema)).count() == 0
    long = "x " * 200_000
    rows = [(3, "a b c d"), (3, "a b c d"), (2, None), (2, ""), (None, "q r"), (None, "s t"), (1, " \n"), (0, long), (0, "Y")]
    docs = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], schema)
    found = fingerprints.fingerprints_of_edits(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in found) == sorted(
        (i is None, i, len(t or "")) for i, t in rows
    )
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first, second = (r for r in sorted(found, key=lambda r: r.near_next) if r.doc_id == 3)
    assert (first.near_next, second.near_next) == (0.0, 1.0)
    assert (first.edited_sha256, second.edited_sha256) == (sha("a b "), sha("a b a b"))
    for r in found:
        if r.doc_id == 2:
            assert (r.fingerprint, r.near_edited, r.edited_sha256) == ("", 1.0, sha(""))
    alone = fingerprints.fingerprints_of_edits(spark.createDataFrame([(7, "one two")], "doc_id long, text string")).first()
    assert (alone.near_next, alone.edited_sha256) == (1.0, sha("one one"))


def test_rows_without_an_id_spread(spark):
    """Rows of one id are told apart by their text, so they share no key."""
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(500)], "doc_id long, text string")
    found = fingerprints.fingerprints_of_edits(docs)
    assert found.count() == 500 and found.select("fingerprint").distinct().count() == 500
