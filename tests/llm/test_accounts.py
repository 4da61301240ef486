"""Account numbers with something in capitals or digits beside them."""

import pytest

from veilframe.llm import pii

DE, GB = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
TEXTS = [
    (f"IBAN {DE} BIC COBADEFF", [DE]),
    (f"{GB} 2024", [GB]),
    (f"pay {DE} {GB} OK", [DE, GB]),
    (f"PO12 {DE}", [DE]),
    (f"NO13 {DE} 7", [DE]),
    (f"to {DE} Bank, then {GB}.", [DE, GB]),
    (f"A1 {GB}\n{DE}", [GB, DE]),
    ("XX89 3704 0044 0532 0130 00 BIC", []),
    (f"x{GB} {GB}x {GB}7", []),
    ("DE88 3704 0044 0532 0130 00 BIC COBADEFF", []),
    (f"été 👍 {GB} {GB} 1", [GB, GB]),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.redacted(pii.find_pii(docs)).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_account_numbers(found, i):
    text, want = TEXTS[i]
    spans = [x for x in found[i].pii if x.kind == "iban"]
    assert [x.value for x in spans] == want
    assert [text[x.start : x.end] for x in spans] == want
    assert all(v not in found[i].text for v in want)


def test_very_many_heads_in_one_text(spark):
    docs = spark.createDataFrame([(1, f"{GB} AB12 " * 3_000)], "doc_id long, text string")
    spans = [x for x in pii.find_pii(docs).first().pii if x.kind == "iban"]
    assert len(spans) == 3_000 and {x.value for x in spans} == {GB}
