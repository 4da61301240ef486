"""Nulls, empty texts, repeated rows, extra columns and empty tables."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import ann, chat, decontaminate, html, licenses, mixing, pii, setjoin, warc

DOCS = "doc_id long, text string, source string, key string, size int, row int, hash int"
ROWS = [
    (1, "one two three four five six", "a", "x", 1, 1, 1),
    (1, "one two three four five six", "a", "x", 1, 1, 1),
    (2, None, None, None, None, None, None),
    (3, "", "b", "x", 1, 1, 1),
    (None, "mail me@x.org now", "b", "x", 1, 1, 1),
    (4, "w " * 30_000, "b", "x", 1, 1, 1),
]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_documents(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(1, "three four"), (None, None)] if rows else [], "item_id long, text string")
    assert pii.report(docs).count() == len(rows)
    assert decontaminate.report(docs, items).count() == len(rows)
    assert setjoin.jaccard_components(docs).count() == len(rows)
    assert licenses.report(docs).count() == len(rows)
    assert mixing.report(docs).count() == len(rows)


@pytest.mark.parametrize("rows", [[(1, None, None), (1, None, None), (None, "http://h/", "<p>a<p>b&amp;"), (2, "x", "")], []])
def test_pages(spark, rows):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, page int")
    found = html.report(pages).collect()
    assert sorted(r.text for r in found) == (["", "", "", "a\nb&"] if rows else [])
    assert warc.round_trip(pages).count() == len(rows)


def test_site_templates_go_and_copies_stay(spark):
    page = "<body><div><i>our site</i></div><div>text {}</div></body>"
    rows = [(i, "http://h/", page.format(i)) for i in range(6)]
    rows += [(10 + i, "http://k/", page.format("same")) for i in range(6)]
    found = html.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in found}
    assert [texts[i] for i in range(6)] == [f"text {i}" for i in range(6)]
    assert {texts[10 + i] for i in range(6)} == {"our site\ntext same"}


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, id int, shard int"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, None]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [2.0, 0.0]), (7, [1.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0])]
    found = ann.nearest(spark.createDataFrame([(*r, 1, 1) for r in rows], schema)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(0, 1, 1, 0.0), (0, 2, 6, 1.0)]


def test_turns(spark):
    schema = "conv_id long, turn long, role string, text string, block int"
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "assistant", "<|im_end|>\\ <\\| <"), (1, None, None, None), (None, 70, "assistant", "\n\nÉ 👍🏽\n"), (None, 1, "a\nb", "x")]
    blocks = chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], schema))
    found = {r.conv_id: r for r in chat.digests(blocks).collect()}
    assert (found[1].n_turns, found[1].loss_chars) == (2, len("<|im_end|>\\ <\\| <"))
    assert (found[None].n_turns, found[None].loss_chars) == (2, len("\n\nÉ 👍🏽\n"))


def test_blocks_of_conversations_are_given_out_together(spark, monkeypatch):
    """op10: blocks leave a task many at a time, come in a few at a time, and say the same however they are cut."""
    rows = [(i // 3, i % 3, ["user", "assistant", "assistant"][i % 3], ["hé ", "", "<|x|> 🙂🙂 ok", None][i % 4]) for i in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    made = chat.format_conversations(turns, block_turns=2)
    given, frame = [], type(turns)
    with monkeypatch.context() as m:
        m.setattr(frame, "mapInArrow", lambda df, run, schema: given.append(run) or df)
        chat.format_conversations(turns, block_turns=2)
    batch = pa.RecordBatch.from_pydict({
        "conv_id": [r[0] for r in rows], "block": [r[1] // 2 for r in rows], "turn": [r[1] for r in rows],
        "role": [r[2] for r in rows], "text": [r[3] or "" for r in rows],
    })
    assert [b.num_rows for b in given[0](iter([batch]))] == [40]
    found = sorted(map(tuple, chat.digests(made).collect()))
    monkeypatch.setattr(chat, "GIVEN_OUT", 1)
    monkeypatch.setattr(chat, "TAKEN", 1)
    assert sorted(map(tuple, chat.digests(chat.format_conversations(turns, block_turns=2)).collect())) == found
    want = []
    for c in range(20):
        texts = [(r, t or "") for i, _, r, t in rows if i == c]
        said = "".join(t for r, t in texts if r == "assistant")
        want.append((
            c, 3, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest(),
            len(said), hashlib.sha256(said.encode()).hexdigest(),
        ))
    assert [x[:5] for x in found] == want


def test_shares_of_tokens_are_those_of_one_by_one():
    """op10: tokens and answers are intersected at once; several tokens may lie in one character."""
    starts, ends = np.array([0, 3, 3, 4, 6, 9]), np.array([3, 4, 4, 6, 9, 12])
    spans = [(1, 4), (5, 5), (7, 20)]
    want, clear = [], [0, 3, 4, 4, 6, 9]
    for a, b in spans:
        for t in range(6):
            if ends[t] > a and starts[t] < b:
                begin = max(a, clear[t])
                want.append([t, begin, max(min(b, int(ends[t])), begin)])
    assert chat.intersect(spans, starts, ends).tolist() == want
    assert chat.intersect([], starts, ends).shape == chat.intersect([(0, 1)], starts[:0], ends[:0]).shape == (0, 3)
