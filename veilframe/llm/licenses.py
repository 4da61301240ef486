"""Short licence notices, also misspelt ones.

A notice of at most E edits holds one of its E + 1 pieces unchanged (pigeonhole).
One automaton finds the pieces of all notices; around each piece the regex
library matches the whole notice with bounded errors and gives span and edits.

Next to that, phrases of whole words are counted (``PHRASES``): a place where
their words stand one after another, whatever stands between the words.

Edge cases: a null text is empty; spans count characters of the lower-cased (A-Z)
text, which has the same length as the text; equal spans of one label are given
once; every document row gives one result row, also repeated ones.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.words import LOWER, PLAIN, slices, words_of

# The phrases of the contract, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# The short notices that are looked for, with their labels.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms, with or without modification": "bsd",
    "licensed under the gnu general public license": "gpl",
    "this program is free software: you can redistribute it and/or modify": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by-nc": "cc-by-nc",
    "licensed under a creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
}
# One edit for so many characters of a notice.
CHARS_PER_EDIT = 10

SCHEMA = (
    "n_words long, places array<struct<word:long,label:string>>, "
    "notices array<struct<start:int,end:int,label:string,edits:int>>"
)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into ``edits`` + 1 pieces of nearly equal length, with their places."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    """Automaton and patterns for a list of notices."""

    def __init__(self, notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT):
        seeds: dict[str, list[tuple[str, int]]] = {}
        self.patterns, self.edits = {}, {}
        for notice in notices:
            k = len(notice) // chars_per_edit
            for at, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((notice, at))
            self.edits[notice] = k
            # The best match inside a window, not the first that is good enough.
            self.patterns[notice] = regex.compile(
                f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"
            )
        self.labels = notices
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices in a lower-cased text, by start."""
        windows: dict[str, list[list[int]]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            for notice, at in uses:
                k = self.edits[notice]
                begin = last + 1 - length - at
                a, b = max(0, begin - k), min(len(text), begin + len(notice) + k)
                spans = windows.setdefault(notice, [])
                # Windows that touch are one: each hit is then looked at once.
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                    spans[-1][0] = min(a, spans[-1][0])
                else:
                    spans.append([a, b])
        found = set()
        for notice, spans in windows.items():
            for a, b in spans:
                for m in self.patterns[notice].finditer(text, a, b):
                    found.add((m.start(), m.end(), self.labels[notice], sum(m.fuzzy_counts)))
        return sorted(found)


def phrase_places(words, hashes: np.ndarray, phrases: dict[str, str]):
    """(text, word, label) for each place of a phrase; hashes propose, words confirm."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out = []
    for phrase, label in phrases.items():
        own = words_of(pa.array([phrase]), PLAIN)
        target, n = own.hashes(), len(own.starts)
        m = len(hashes) - n + 1
        if m <= 0:
            continue
        same = np.ones(m, dtype=bool)
        for j in range(n):
            same &= hashes[j : j + m] == target[j]
        same &= text[:m] == text[n - 1 :]
        expected = [own.text(j) for j in range(n)]
        for i in np.flatnonzero(same).tolist():
            if [words.text(i + j) for j in range(n)] == expected:
                out.append((int(text[i]), i - int(words.first[text[i]]), label))
    return out


def find_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    notices: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Per document: doc_id, n_words, places of phrases, and notices with span and edits."""
    notices = NOTICES if notices is None else notices
    phrases = PHRASES if phrases is None else phrases

    def run(batches):
        search = Search(notices)
        low = {i: int(LOWER[i]) for i in range(65, 91)}
        for batch in slices(batches, "text"):
            words = words_of(batch.column(1), PLAIN)
            places: list[list] = [[] for _ in range(batch.num_rows)]
            for i, word, label in phrase_places(words, words.hashes(), phrases):
                places[i].append({"word": word, "label": label})
            hits = [
                [
                    dict(zip(("start", "end", "label", "edits"), hit, strict=True))
                    for hit in search((t.as_py() or "").translate(low))
                ]
                for t in batch.column(1)
            ]
            for p in places:
                p.sort(key=lambda x: (x["word"], x["label"]))
            struct = pa.struct([("word", pa.int64()), ("label", pa.string())])
            span = pa.struct(
                [("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words.counts(), pa.int64()),
                    pa.array(places, pa.list_(struct)),
                    pa.array(hits, pa.list_(span)),
                ],
                ["doc_id", "n_words", "places", "notices"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def report(docs: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a phrase stands or a notice stands unchanged, and falls
    with the edits of the best notice.
    """
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    best = F.expr(
        f"array_max(transform(notices, x -> 1 - x.edits / greatest((x.end - x.start) / {CHARS_PER_EDIT}D, x.edits + 1)))"
    )
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))
    return find_licenses(docs, **names).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "notices.label")).alias("labels"),
        score.cast("double").alias("score"),
    )
