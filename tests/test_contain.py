"""Containment against looking for every needle in every text."""

import random

from pyspark.sql import functions as F

from veilframe.operators import boxes, contain


def places(texts, needles):
    out = set()
    for k, (g, text) in texts.items():
        for h, n in needles:
            if g != h or not n:
                continue
            at = text.find(n)
            while at >= 0:
                out.add((k, n, at))
                at = text.find(n, at + 1)
    return out


def test_against_every_pair(spark):
    dice = random.Random(2)
    word = lambda a, b: "".join(dice.choice("abé ") for _ in range(dice.randint(a, b)))
    needles = sorted({(dice.choice("xy"), word(0, 9)) for _ in range(150)})
    texts = {i: (dice.choice("xyz"), word(0, 900)) for i in range(60)}
    n = spark.createDataFrame(needles, "g string, needle string")
    t = spark.createDataFrame([(k, *v) for k, v in texts.items()], "k int, g string, text string")
    found = contain.occurrences(t, n, ["g"]).collect()
    assert all(r.ln == len(r.needle) for r in found)
    got = [(r.k, r.needle, r.st) for r in found]
    assert len(got) == len(set(got)) and set(got) == places(texts, needles)
    hays = t.select("g", F.col("text").alias("hay")).distinct()
    pairs = {(r.g, r.needle, r.hay) for r in contain.contained_in(n, hays, ["g"]).collect()}
    assert pairs == {(g, s, text) for g, text in texts.values() for h, s in needles if g == h and s and s in text}


def test_needles_that_begin_alike_meet_only_their_texts(spark):
    """Ten thousand numbers of one group: as many pairs as there are hits, or nearly so."""
    needles = spark.range(10_000).selectExpr(
        "'g' as g", "concat('+7 900 ', lpad(cast(id * 7919 % 1000000 as string), 6, '0')) as needle"
    )
    texts = needles.where("hash(needle) % 5 = 0").selectExpr("g", "needle as k", "concat('call ', needle, ' now') as text")
    longest = texts.count()
    keyed = contain.anchored(needles, texts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 3), lambda i: F.substring("text", i, F.lit(4)))).alias("gram")))
    pieces = texts.select("g", "k", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 3), lambda i: F.substring("text", i, F.lit(4)))).alias("gram"))
    assert pieces.join(keyed, ["g", "gram"]).count() < 40 * longest
    assert contain.occurrences(texts, needles, ["g"]).count() == longest


def test_long_needles_and_none(spark):
    long = "".join(f"{i:05d}" for i in range(400))
    t = spark.createDataFrame([(1, "g", "x" * 3_000 + long + long), (2, "g", None), (3, "g", "")], "k int, g string, text string")
    n = spark.createDataFrame([("g", long), ("g", long + "!"), ("g", "")], "g string, needle string")
    assert sorted((r.k, r.st) for r in contain.occurrences(t, n, ["g"]).collect()) == [(1, 3_000), (1, 5_000)]
    assert contain.occurrences(t, n.limit(0), ["g"]).columns == ["g", "k", "st", "ln", "needle"]
    assert contain.occurrences(t, n.limit(0), ["g"]).count() == 0


def test_boxes_of_pages_with_many_words(spark):
    """Few and many sensitive words give the same boxes."""
    words = spark.createDataFrame([(p, i, w) for p in (1, 2) for i, w in enumerate(["Ann", " anna ", "bo", "xx", "annabel", ""])], "page int, n int, word string")
    few = [(1, "ann"), (1, "zannazz"), (2, "bobby")]
    many = few + [(2, f"{i:04d}") for i in range(200)]
    for known in (few, many):
        s = spark.createDataFrame(known, "page int, word string")
        found = sorted((r.page, r.n, r.word) for r in boxes.redaction_boxes(words, s, ["page"]).collect())
        assert found == [(1, 0, "Ann"), (1, 1, " anna "), (1, 4, "annabel"), (2, 2, "bo")]


def test_anchors_of_one_pass_are_held_at_a_time(spark, monkeypatch):
    """passes are written one after the other, so the plan that is left broadcasts no anchors of theirs."""
    texts = spark.createDataFrame([(i, "g", f"a{i:04d}b и c{i + 1:04d}d") for i in range(60)], "k long, s string, text string")
    needles = spark.createDataFrame([("g", f"a{i:04d}b") for i in range(0, 60, 2)] + [("g", "0d"), ("h", "a0001b")], "s string, needle string")
    want = sorted(tuple(r) for r in contain.occurrences(texts, needles, ["s"]).select("k", "needle", "st", "ln").collect())
    assert len([w for w in want if w[1] != "0d"]) == 30 and [w for w in want if w[1] == "0d"]
    written = []
    kept = contain.staged
    monkeypatch.setattr(contain, "staged", lambda df, label: written.append(label) or kept(df, label))
    monkeypatch.setattr(contain, "BROADCAST_ANCHORS", 5)
    several = contain.occurrences(texts, needles, ["s"])
    assert written[0] == "anchors" and written[1:] == ["places"] * (len(written) - 1) and len(written) > 3
    assert "LeftSemi" not in several._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in several.select("k", "needle", "st", "ln").collect()) == want
