"""Main text of web pages, without what the site repeats on its pages.

A page is parsed once into text blocks in page order. Every element that holds
blocks is hashed with all that is below it. Spark counts, per host, on how many
different pages each subtree stands, and subtrees that recur are deleted, with
their blocks. Pages with the same main text count once, so copies of a page, also
with another menu or link, are no template; neither are paragraphs and the like
inside an article, which may quote each other, the article itself, what stands
around it, or any element with more than three quarters of a page's main text.

Rules go beside the counts: elements that are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or comments by tag, class, id or role
never count as main text; the header of an article is part of it. Where a page has a main
element, that is main text, and of it only the articles if they hold most of its text;
else its articles; else the body.

Edge cases: a null or empty html gives an empty text; without a host no subtree
is a template; repeated rows give repeated results; unclosed tags end with their
parent; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import staged

# A subtree is a template from so many different pages, and this share of its host's.
MIN_PAGES = 5
MIN_SHARE = 0.05
# An element with more than this share of its page's main text is no template.
MOST = 0.75
# As many templates are told to every task. Beyond that only those that hold a thousandth of all
# subtrees are, at most 1000; pages meet the others by a join.
BROADCAST_TEMPLATES = 1_000_000
HEAVY_SHARE = 1000

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head title script style noscript template iframe svg math canvas object audio video".split())
ASIDE = frozenset("nav header footer aside form button select textarea option dialog menu label fieldset".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary".split())
BLOCK = TEXT | frozenset(
    "html body address article center details div dl fieldset figure footer form header hr main menu nav "
    "ol section table tbody thead tfoot ul aside dialog".split()
)
ROOT = frozenset(["html", "body", "article", "main"])
# Where blocks stand: aside, elsewhere, in a main element, in an article, in an article of a main element.
ASIDE_LEVEL, ELSEWHERE, IN_MAIN, IN_ARTICLE, IN_BOTH = -1, 0, 1, 2, 3
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads adbox advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe signup login sidebar side aside widget menu nav navbar navigation "
    "breadcrumb breadcrumbs pager pagination header masthead footer copyright share sharing social related "
    "recommended teaser teasers comment comments commentlist reply replies disqus form search skip".split()
)
# Words that say nothing about what an element is; a name of one mark and such words is a mark.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons column container content global group icon icons inner item items "
    "label left link links list main outer page panel position posts primary region right row secondary section "
    "site slot space sticky sub tools top unit wrap wrapper".split()
)


def is_mark(name: str) -> bool:
    """Does a class or id say that an element is no main text? ``site-header`` does, ``entry-header`` doesn't."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return any(x in MARKS for x in parts) and all(x in MARKS or x in NEUTRAL for x in parts)


def is_aside(tag: str, attrs: list[tuple[str, str | None]], level: int) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in ASIDE and not (tag == "header" and level >= IN_ARTICLE):
        return True
    for name, value in attrs:
        if name == "role" and (value or "").strip().lower() in ROLES:
            return True
        if name in ("class", "id") and any(map(is_mark, (value or "").lower().split())):
            return True
        if name == "hidden":
            return True
    return False


class Page(HTMLParser):
    """Text blocks of a page, and the range of blocks and the hash of each element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int]] = []  # text and level
        self.subtrees: list[tuple[int, int, int]] = []  # hash, first block, end block
        self.wanted = {ELSEWHERE}
        self.open: list[list] = []  # tag, level before, first block, digest, highest level of its blocks
        self.level = 0
        self.silent = 0
        self.words: list[str] = []

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.blocks.append((text, self.level))
            if self.open:
                self.open[-1][3].update(b"\0" + text.encode("utf-8", "replace"))
                self.open[-1][4] = max(self.open[-1][4], self.level)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            self.end_implied(tag)
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        self.open.append([tag, self.level, len(self.blocks), hashlib.blake2b(tag.encode(), digest_size=8), -1])
        if tag in NO_TEXT:
            self.silent += 1
        if self.level >= 0:
            if is_aside(tag, attrs, self.level):
                self.flush_inline(tag)
                self.level = ASIDE_LEVEL
            elif tag == "article":
                self.level = IN_BOTH if self.level in (IN_MAIN, IN_BOTH) else IN_ARTICLE
            elif tag == "main" or ("role", "main") in attrs:
                self.level = IN_BOTH if self.level >= IN_ARTICLE else IN_MAIN

    def flush_inline(self, tag):
        """Text before an inline element of another level is a block of its own."""
        if tag not in BLOCK:
            last = self.open.pop()
            self.flush()
            last[2] = len(self.blocks)
            self.open.append(last)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def end_implied(self, tag):
        """A new block ends an open paragraph; a new item ends the open item of its list."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name not in BLOCK:
                continue
            same = name == tag and tag in ("li", "dt", "dd", "tr", "td", "th")
            if name == "p" or same or (name in ("dt", "dd") and tag in ("dt", "dd")):
                self.end_to(i)
            return

    def end_to(self, i: int):
        while len(self.open) > i:
            tag, before, first, digest, _ = self.open[-1]
            if tag in BLOCK or before != self.level:
                self.flush()
            high = self.open.pop()[4]
            if tag in NO_TEXT:
                self.silent -= 1
            value = digest.digest()
            if self.open:
                self.open[-1][3].update(b"\1" + value)
                self.open[-1][4] = max(self.open[-1][4], high)
            quoted = tag in TEXT and self.level > 0
            # Its level, before a main element or article in it raised that of their blocks.
            around = high > max(self.level, 0)
            if tag in BLOCK and tag not in ROOT and not quoted and not around and first < len(self.blocks):
                self.subtrees.append((int.from_bytes(value, "big", signed=True), first, len(self.blocks)))
            self.level = before

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.end_to(i)
                return

    def parse_marked_section(self, i, report=1):
        """A section of a kind that HTML doesn't know ends with the next sign, as a comment does."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)

    def done(self):
        self.close()
        self.end_to(0)
        self.flush()
        held = [0] * (IN_BOTH + 1)
        for text, level in self.blocks:
            if level >= 0:
                held[level] += len(text)
        if held[IN_MAIN] or held[IN_BOTH]:
            self.wanted = {IN_BOTH} if held[IN_BOTH] >= held[IN_MAIN] else {IN_MAIN, IN_BOTH}
        elif held[IN_ARTICLE]:
            self.wanted = {IN_ARTICLE}
        sizes = [len(text) if level in self.wanted else 0 for text, level in self.blocks]
        up_to = [0, *accumulate(sizes)]
        most = MOST * up_to[-1]
        self.subtrees = [s for s in self.subtrees if not 0 < most < up_to[s[2]] - up_to[s[1]]]
        return self

    def core(self) -> int:
        """A hash of the main text."""
        main = "\n".join(text for text, level in self.blocks if level in self.wanted)
        value = hashlib.blake2b(main.encode("utf-8", "replace"), digest_size=8).digest()
        return int.from_bytes(value, "big", signed=True)


PARSED = (
    "page_id {id}, url string, page long, core long, main array<boolean>, blocks array<string>, "
    "subtrees array<struct<hash:bigint,first:int,end:int>>"
)
SUBTREE = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, hashes of the html and the main text, its blocks, which are main text, and its subtrees."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"), F.xxhash64(html).alias("page"),
    )
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            core, main, blocks, subtrees = [], [], [], []
            for text in batch.column(2):
                page = Page()
                page.feed(text.as_py())
                page.done()
                core.append(page.core())
                # Only the place of other text is needed.
                main.append([level in page.wanted for _, level in page.blocks])
                blocks.append([b if level in page.wanted else "" for b, level in page.blocks])
                subtrees.append([dict(zip(("hash", "first", "end"), s, strict=True)) for s in page.subtrees])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(3), pa.array(core, pa.int64()),
                    pa.array(main, pa.list_(pa.bool_())), pa.array(blocks, pa.list_(pa.string())),
                    pa.array(subtrees, pa.list_(SUBTREE)),
                ],
                ["page_id", "url", "page", "core", "main", "blocks", "subtrees"],
            )

    return rows.mapInArrow(run, PARSED.format(id=kind))


def host_of(url):
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, hash, n: subtrees that recur on the pages of a host."""
    # A different page is one with another main text; each counts once for a subtree.
    of_page = rows.where("host is not null").select("host", "core", F.explode("hashes").alias("hash")).distinct()
    counts = of_page.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = (
        rows.where("host is not null").select("host", "core").distinct()
        .groupBy("host").agg(F.count("*").alias("pages"))
    )
    return counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * min_share).select("host", "hash", "n")


def _kept(marked: DataFrame) -> DataFrame:
    """The main text outside the subtrees whose hashes are in ``deleted``."""
    marked = marked.withColumn("ranges", F.expr("filter(subtrees, s -> array_contains(deleted, s.hash))"))
    kept = F.expr(
        "filter(blocks, (b, i) -> main[i] and not exists(ranges, s -> s.first <= i and i < s.end))"
    )
    return marked.select(
        "page_id", "url", F.array_join(kept, "\n").alias("text"), F.size("deleted").alias("n_templates")
    )


def extract(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Per page: page_id, url, text, n_templates (its subtrees that recur)."""
    rows = staged(parsed(pages, page_id, url, html).withColumn("host", host_of(F.col("url"))), "html-blocks")
    rows = rows.withColumn("hashes", F.array_distinct("subtrees.hash"))
    counted = staged(templates(rows, min_pages, min_share), "html-templates")

    none = F.array().cast("array<bigint>")
    if counted.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        every = counted.groupBy("host").agg(F.collect_list("hash").alias("all")).withColumnRenamed("host", "h")
        told = rows.join(F.broadcast(every), F.col("host") == F.col("h"), "left")
        return _kept(told.withColumn("deleted", F.array_intersect("hashes", F.coalesce("all", none))))
    # Templates of very many pages go to all tasks, the others meet their pages by host and hash.
    total = rows.agg(F.sum(F.size("hashes"))).first()[0] or 0
    heavy = counted.where(F.col("n") * HEAVY_SHARE >= total).groupBy("host").agg(
        F.collect_list("hash").alias("heavy")
    ).withColumnRenamed("host", "h")
    other = counted.where(F.col("n") * HEAVY_SHARE < total).select("host", "hash")
    # A page is known by its host and the hash of its html; equal pages share an answer.
    light = (
        rows.join(F.broadcast(heavy), F.col("host") == F.col("h"), "left")
        .where("host is not null")
        .select("host", "page", F.explode(F.array_except("hashes", F.coalesce("heavy", F.array().cast("array<bigint>")))).alias("hash"))
        .distinct()
        .join(other, ["host", "hash"])
        .groupBy("host", "page")
        .agg(F.collect_set("hash").alias("light"))
        .select(F.col("host").alias("l"), F.col("page").alias("p"), "light")
    )
    # Pages that hold nothing light need no partner; what their rows hash to spreads them.
    deleted = F.array_intersect("hashes", F.concat(F.coalesce("heavy", none), F.coalesce("light", none)))
    marked = (
        rows.join(F.broadcast(heavy), F.col("host") == F.col("h"), "left")
        .join(light, (F.col("host") == F.col("l")) & (F.col("page") == F.col("p")), "left")
        .withColumn("deleted", deleted)
    )
    return _kept(marked)


def report(pages: DataFrame, **names) -> DataFrame:
    """page_id, url, text, n_chars, n_templates."""
    return extract(pages, **names).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates"
    )
