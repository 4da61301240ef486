"""Near copies of a page whose main text has elements around it."""

import pytest

from veilframe.llm import html

SCHEMA = "page_id long, url string, html string"
STORY = "<div><h1>A story</h1></div><div>that was told in one place</div><div>and came to be told in others</div>"
WANT = "A story\nthat was told in one place\nand came to be told in others"


@pytest.mark.parametrize(
    "page",
    [
        "<body><div id=wrap><article>{s}</article></div><p>visit {i}</p></body>",
        "<body><table><tr><td><main>{s}</main></td></tr></table><p>visit {i}</p></body>",
        "<body><section><div><article><div>{s}</div></article></div></section><nav>menu {i}</nav></body>",
        "<body><div><div role=main>{s}</div></div><div>advert {i}</div></body>",
        "<body><center>{s}</center><nav>menu {i}</nav></body>",
        "<body><div>{s}</div><a href='/?visit={i}'></a></body>",
    ],
)
def test_near_copies_keep_their_text(spark, page):
    rows = [(i, "http://h/", page.format(i=i, s=STORY)) for i in range(8)]
    found = html.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.text for r in found] == [WANT] * 8


def test_a_wrapper_with_most_of_the_text_stays(spark):
    page = "<body><div>{s}</div><div>ad {i}</div></body>"
    rows = [(i, "http://h/", page.format(i=i, s="<b>" + "long text " * 9 + "</b>")) for i in range(8)]
    found = html.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all("long text" in r.text for r in found)


def test_boxes_in_wrapped_articles_still_go(spark):
    page = "<body><div><article><div>our box</div><p>a text of its own, number {i}</p></article></div></body>"
    rows = [(i, "http://h/", page.format(i=i)) for i in range(8)]
    found = {r.page_id: r.text for r in html.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"a text of its own, number {i}" for i in range(8)}
