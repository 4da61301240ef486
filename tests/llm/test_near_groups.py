"""Components of large groups of near copies, and how many pairs they are searched with."""

import random

import brute
import pytest

from veilframe.llm import setjoin


def near_copies(copies, seed=7):
    """Texts that differ from one text in a word or two: those with one link with all, the others not with each other."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = {}
    for i in range(copies):
        text = list(base)
        for at in rng.sample(range(150), 1 if i % 3 == 0 else 2):
            text[at] = f"x{rng.randrange(10**6)}"
        out[i] = " ".join(text)
    return out


@pytest.mark.parametrize(("copies", "list_rows"), [(300, 4096), (60, 8)])
def test_large_groups_need_few_pairs(spark, monkeypatch, copies, list_rows):
    docs = near_copies(copies)
    asked, search = [], setjoin.search

    def counted(source, k, pairs, classes):
        asked.append(pairs.count())
        return search(source, k, pairs, classes)

    monkeypatch.setattr(setjoin, "search", counted)
    monkeypatch.setattr(setjoin, "LIST_ROWS", list_rows)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(rows).collect()}
    assert found == brute.jaccard(docs)
    # The rest after the stars: pairs in the order of the rows of a list, not of their square.
    # Lists cut into blocks give as many for each block.
    if list_rows > copies:
        assert sum(asked[1:]) <= 3 * copies, asked
