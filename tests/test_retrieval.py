"""Retrieval for many questions against comparing all with all."""

import math
import random
from collections import Counter

import pytest

from veilframe.operators import retrieval


def test_nearest_is_exact(spark, monkeypatch):
    dice = random.Random(4)
    rows = [(i, [dice.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0] * 5), (403, [float("nan")] * 6), (None, [1.0] * 6), (404, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b), 10)

    fine = {i: v for i, v in rows if i is not None and i < 400} | {402: [1.0] * 5}
    want = {}
    for q in fine:
        if q % 7 == 0 or q == 402:
            scored = sorted((-cosine(fine[q], v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
            want[q] = [(i, -s) for s, i in scored[:5]]
    asked = vectors.where("vec_id % 7 = 0 OR vec_id >= 400")
    monkeypatch.setattr(retrieval, "VECTORS", 37)
    for at_once in (4_096, 10):
        found = retrieval.nearest(asked, vectors, 5, questions_at_once=at_once).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.question, r.rank)):
            got.setdefault(r.question, []).append((r.vec_id, round(r.score, 10)))
        assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items() if w}
        assert all(abs(s - t) < 1e-9 for q, w in got.items() for (_, s), (_, t) in zip(w, want[q], strict=True))
    assert retrieval.nearest(asked.limit(0), vectors, 5).count() == 0


@pytest.mark.parametrize("postings", [2, 128])
def test_an_index_gives_what_full_scoring_gives(spark, tmp_path, monkeypatch, postings):
    monkeypatch.setattr(retrieval, "POSTINGS", postings)
    dice = random.Random(6)
    common = ["the", "of", "and"]
    docs = [(i, " ".join(dice.choices(common + [f"w{dice.randint(0, 40)}"], k=dice.randint(0, 40)))) for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(30)] + [(400, ""), (401, None)]
    retrieval.write_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    words = {i: Counter(t.split()) for i, t in docs if t is not None}
    n, avgdl = len(words), sum(sum(c.values()) for c in words.values()) / len(words)
    df = Counter(w for c in words.values() for w in c)
    asked = [(q, dice.sample(common, 2) + [f"w{dice.randint(0, 45)}", "nowhere"]) for q in range(40)] + [(99, []), (98, ["the", "the"])]
    want = {}
    for q, terms in asked:
        scores = {}
        for i, c in words.items():
            dl = sum(c.values())
            parts = [
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / avgdl))
                for t in set(terms) if c[t]
            ]
            if parts:
                scores[i] = round(sum(parts), 9)
        if scores:
            want[q] = [i for _, i in sorted((-s, i) for i, s in scores.items())[:4]]
    questions = spark.createDataFrame(asked, "question long, terms array<string>")
    got = {}
    for r in sorted(retrieval.bm25_many(questions, str(tmp_path / "i"), 4).collect(), key=lambda r: (r.question, r.rank)):
        got.setdefault(r.question, []).append(r.doc)
    assert got == want


def test_postings_move_once_and_repeated_documents_are_one(spark, tmp_path, monkeypatch):
    """words are counted in the row, and the only shuffle of postings is the one by ranges."""
    monkeypatch.setattr(retrieval, "POSTINGS", 3)
    docs = [(i % 8, "of the of a") for i in range(10)] + [(8, "of"), (8, "of the"), (9, ""), (9, None), (None, "of")]
    plans, seen = [], type(spark.range(1)).mapInArrow

    def watched(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return seen(df, *args, **options)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        retrieval.write_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0] and "Window" not in plans[0]
    blocks = spark.read.parquet(str(tmp_path / "i/blocks")).collect()
    assert all(len(b.postings) <= 3 and b.most == max(p.weight for p in b.postings) for b in blocks)
    dls = [4] * 10 + [1, 2, 0]
    n, avgdl = len(dls), sum(dls) / len(dls)
    tfs = {("of", i, 4): 2 * (1 + (i < 2)) for i in range(8)} | {("the", i, 4): 1 + (i < 2) for i in range(8)}
    tfs |= {("a", i, 4): 1 + (i < 2) for i in range(8)} | {("of", 8, 1): 1, ("of", 8, 2): 1, ("the", 8, 2): 1}
    want = sorted((t, i, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) for (t, i, dl), tf in tfs.items())
    got = sorted((b.term, p.doc, p.weight) for b in blocks for p in b.postings)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))
    terms = {r.term: r.df for r in spark.read.parquet(str(tmp_path / "i/terms")).collect()}
    assert terms == {"of": 10, "the": 9, "a": 8}


def test_questions_are_asked_with_all_their_words(spark, tmp_path):
    """the words after the fifth of a question count too, in the query and in its SQL."""
    import duckdb

    import __spark_entry__ as entry

    docs = [(1, "one two"), (2, "two three four five"), (3, "six seven eight"), (4, "eight"), (5, "")]
    asked = [(10, "one two three four five SIX seven"), (11, "a b c d e eight"), (12, ""), (13, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = entry.queries()["lexical_retrieval_many"](spark, str(tmp_path)).collect()
    got = sorted((r.question, r["rank"], r.doc, r.score) for r in rows)
    assert [x[:3] for x in got if x[0] == 11] == [(11, 1, 4), (11, 2, 3)] and {x[2] for x in got if x[0] == 10} == {1, 2, 3}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT question, rank, doc, score FROM ({entry.oracle_sql()['lexical_retrieval_many']})").fetchall())
