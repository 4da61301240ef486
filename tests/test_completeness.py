"""Nothing is lost where a map is large, a name is long, numbers have gaps or a key is missing."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import entities, gazetteer, restoring
from veilframe.plans import jobs


def test_large_maps_restore_like_small_ones(spark):
    tokens = spark.range(300).selectExpr(
        "if(id < 290, 'big', 'small') as s", "concat('<PERSON_', id, '>') as token", "concat('name ', id) as original"
    )
    texts = spark.createDataFrame(
        [(1, "big", "a <PERSON_7> b <PERSON_289>"), (2, "small", "c <PERSON_295>"), (3, "none", "d <PERSON_1>")],
        "k int, s string, text string",
    )
    back = restoring.restore_folding(texts, "text", tokens, ["s"], ["k"], "back")
    assert {r.k: r.back for r in back.collect()} == {
        1: "a name 7 b name 289", 2: "c name 295", 3: "d <PERSON_1>"
    }


def test_names_as_long_as_the_list_has_them(spark):
    units = spark.createDataFrame([(1, "met Anna Maria von Berg today")], "k int, text string")
    names = spark.createDataFrame([("anna maria von berg", "PERSON", 1.0)], "form string, ty string, score double")
    found = gazetteer.gazetteer_spans(units, names, ["k"]).collect()
    assert [(s.st, s.ln) for s in found[0].spans] in ([(4, 19)], [(5, 19)])


def test_names_and_patterns_over_the_cuts_of_a_long_text(spark):
    """What a long text gives does not depend on where it is cut."""
    listed = spark.createDataFrame([("johnson & johnson", "RU_ORGANIZATION", 0.9)], "form string, ty string, score double")
    said = "Johnson & Johnson, PAN ABCDE1234F; mail a@b.example"
    short = [(i, f"{said} ") for i in range(1)]
    # The first cut is the first mark after 8,192 characters: here it lies in the name, at each of its places.
    long = [(10 + n, "x" * (8192 - n) + f" {said}! " + "y " * 9_000 + said) for n in range(12)]
    texts = spark.createDataFrame(short + long, "doc_seq long, text string")
    done = jobs.mask(texts, lang="en", gazetteer=listed).masked
    for r in done.select("doc_seq", "text", "masked_text", "spans_found").collect():
        copies = r.text.count(said)
        assert r.spans_found == 3 * copies
        assert r.masked_text == r.text.replace(
            said, "<RU_ORGANIZATION_1>, PAN <PAN_IN_1>; mail <EMAIL_ADDRESS_1>"
        )


def test_the_fold_replaces_nothing_inside_an_original(spark):
    """Small and large maps, folded or joined, give the same."""
    rows = [(f"<A_{i}>", f"see <A_{i + 1}>") for i in range(12)]
    tokens = spark.createDataFrame([("s", t, o) for t, o in rows], "s string, token string, original string")
    texts = spark.createDataFrame([(1, "s", "x <A_1> <A_11><A_0> y")], "k int, s string, text string")
    for limit in (0, 256):
        back = restoring.restore_folding(texts, "text", tokens, ["s"], ["k"], "back", limit)
        assert back.first().back == "x see <A_2> see <A_12>see <A_1> y"


def test_numbers_go_on_after_the_highest(spark):
    existing = spark.createDataFrame(
        [("g", "a", "PERSON", "<PERSON_5>", "A")], "group_id string, norm string, ty string, token string, original string"
    )
    first = spark.createDataFrame(
        [("g", "b", "PERSON", 1, 0, 0, 0)],
        "group_id string, norm string, ty string, doc_seq long, unit_no int, pass int, nst int",
    )
    assert [r.n for r in entities.number_entities(first, existing).collect()] == [6]


def test_a_missing_key_is_refused(spark):
    rows = spark.createDataFrame([(None, "write to a@b.com")], "doc_seq long, text string")
    with pytest.raises(Exception, match="null"):
        jobs.mask(rows).masked.select(F.count("*")).collect()
