"""What counts as main text, and templates against a plain count."""

import random
from collections import defaultdict

import pytest

from veilframe.llm import html

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><![foo[bar]]><p>b</p>", "a\nb"),
        ("<main><p>the long main text</p></main><article>a teaser</article>", "the long main text"),
        ("<main><h2>news</h2><article><p>the article itself</p></article></main>", "the article itself"),
        ("<main><p>the long main text</p><article>a teaser</article></main>", "the long main text\na teaser"),
        ("<article><header class=entry-header><h1>T</h1></header><p>a</p></article>", "T\na"),
        ("<article><div class='article-header'><h1>T</h1></div><p>a</p></article>", "T\na"),
        ("<header><h1>site</h1></header><article><p>a</p></article>", "a"),
        ("<div class='site-header'>site</div><p>a</p>", "a"),
        ("<body class='social-science'><div id=legal><p>a</p></div></body>", "a"),
        ("<title>t</title><p>a</p>", "a"),
        ("<article><p>a</p></article><article class='comment'>no</article><article class='teaser related'>no</article>", "a"),
        ("<article><p>a</p><div class='share-bar'>x</div><div class='ad-slot-2'>y</div></article>", "a"),
        ("<article><p>a <!-- no --> b&nbsp;&#x63;<br>d</p><form>no</form></article>", "a b c d"),
    ],
)
def test_main_text(spark, page, want):
    assert html.report(spark.createDataFrame([(1, "http://h/", page)], SCHEMA)).first().text == want


def plain(rows):
    """page_id: text, counting the boxes of pages that are a row of ``<div>`` each."""
    pages = defaultdict(dict)
    for _, host, boxes in rows:
        pages[host]["\n".join(boxes)] = set(boxes)
    out = {}
    for i, host, boxes in rows:
        counts = defaultdict(int)
        for held in pages[host].values():
            for box in held:
                counts[box] += 1
        total = sum(map(len, boxes))
        gone = {
            b for b in boxes
            if counts[b] >= html.MIN_PAGES and counts[b] >= html.MIN_SHARE * len(pages[host]) and len(b) <= html.MOST * total
        }
        out[i] = "\n".join(b for b in boxes if b not in gone)
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_templates_against_a_plain_count(spark, monkeypatch, limit):
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", limit)
    dice = random.Random(1)
    shared = [f"box {i} of the site" for i in range(30)]
    rows = []
    for i in range(400):
        boxes = [f"own text {i} {j}" + "x" * dice.randint(0, 40) for j in range(dice.randint(1, 3))]
        boxes += dice.sample(shared[: 30 if i % 2 else 6], dice.randint(0, 4))
        dice.shuffle(boxes)
        rows.append((i, f"h{i % 2}", boxes))
    rows += [(1_000 + i, h, b) for i, h, b in rows[:40]]
    table = [(i, f"http://{h}/p", "".join(f"<div>{b}</div>" for b in boxes)) for i, h, boxes in rows]
    found = {r.page_id: r.text for r in html.report(spark.createDataFrame(table, SCHEMA)).collect()}
    assert found == plain(rows)
