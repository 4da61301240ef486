"""Benchmark passages in documents, found by winnowing.

Of each run of W hashes of K words in a row the smallest is kept (the last one of
equals). W + K - 1 = 10, so any 10 words that a document shares with an item leave
at least one fingerprint on both sides. Fingerprints are joined; each carries the
words around it, so a hit is extended by comparing words, without going back to
the text. Items of fewer words are one window each, whose fingerprint is the hash
of all their words, looked for at every place of a document.

Edge cases: a null or empty text has no words and no hits; null item_ids are
items like any other but have no place in a list of ids; items with the same
words are found together; a repeated document row gives a repeated result row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import hex_digest, staged
from veilframe.llm.words import (
    PLAIN,
    Words,
    as_long,
    grams,
    key_filter,
    may_hold,
    slices,
    words_of,
)

WINDOW = 10
K = 4
W = WINDOW - K + 1

WORD_LIST = pa.list_(pa.string())
FINGERPRINT = "fp long, size int, before int, around array<string>"


def winnow(g: np.ndarray, text: np.ndarray, w: int) -> np.ndarray:
    """Places of the kept hashes; ``text`` names the text of each hash.

    Windows that would cross into another text are left out. A text of fewer
    than ``w`` hashes has no window.
    """
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    for j in range(1, w):
        other = np.arange(j, n + j)
        best = np.where(g[other] <= g[best], other, best)
    return np.unique(best[text[:n] == text[w - 1 :]])


def picked(words: Words, hashes: np.ndarray, lengths: list[int], bits: np.ndarray | None):
    """Fingerprints as (hash, size, place of its first word)."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    g, at = grams(hashes, words.first, K)
    kept = winnow(g, text[at], W)
    found = [(g[kept], np.full(len(kept), WINDOW), at[kept])]
    for k in lengths:
        short, places = grams(hashes, words.first, k)
        # Another seed for each length keeps the lengths apart.
        found.append((short ^ np.uint64(k), np.full(len(places), k), places))
    fp, size, place = (np.concatenate(x) for x in zip(*found, strict=True))
    if bits is not None:
        passed = may_hold(bits, fp)
        fp, size, place = fp[passed], size[passed], place[passed]
    return fp, size, place, text[place] if len(place) else place


def context(words: Words, place: np.ndarray, size: np.ndarray, text: np.ndarray):
    """Per fingerprint: how many words precede it in its surroundings, and those words."""
    low = np.where(size == WINDOW, np.maximum(place - (WINDOW - K), words.first[text]), place)
    high = np.where(
        size == WINDOW, np.minimum(place + WINDOW, words.first[text + 1]), place + size
    )
    around = [[words.text(i) for i in range(a, b)] for a, b in zip(low, high, strict=True)]
    return place - low, around


def item_fingerprints(items: DataFrame) -> DataFrame:
    """fp, size, before, around, rep for each item text of its own."""

    def run(batches):
        for batch in slices(batches, "text"):
            words = words_of(batch.column(1), PLAIN)
            hashes, counts = words.hashes(), words.counts()
            # Items of fewer than WINDOW words are looked for as a whole.
            lengths = sorted(set(counts[(counts > 0) & (counts < WINDOW)].tolist()))
            fp, size, place, text = picked(words, hashes, lengths, None)
            whole = (size == WINDOW) | (counts[text] == size)
            fp, size, place, text = fp[whole], size[whole], place[whole], text[whole]
            before, around = context(words, place, size, text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text)),
                    as_long(fp),
                    pa.array(size, pa.int32()),
                    pa.array(before, pa.int32()),
                    pa.array(around, WORD_LIST),
                ],
                ["rep", "fp", "size", "before", "around"],
            )

    return items.select("rep", "text").mapInArrow(run, f"rep string, {FINGERPRINT}")


def document_fingerprints(docs: DataFrame, bits, lengths: list[int]) -> DataFrame:
    """Per document one row with n_words, and one for each fingerprint the filter lets pass."""

    def run(batches):
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches, "text"):
            words = words_of(batch.column(1), PLAIN)
            fp, size, place, text = picked(words, words.hashes(), lengths, bitmap)
            before, around = context(words, place, size, text)
            n, m = batch.num_rows, len(fp)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), batch.column(0).take(pa.array(text))]),
                    pa.concat_arrays([pa.array(words.counts()), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([none, pa.array(place - words.first[text], pa.int64())]),
                    pa.concat_arrays([none, as_long(fp)]),
                    pa.concat_arrays([none.cast(pa.int32()), pa.array(size, pa.int32())]),
                    pa.concat_arrays([none.cast(pa.int32()), pa.array(before, pa.int32())]),
                    pa.concat_arrays([pa.nulls(n, WORD_LIST), pa.array(around, WORD_LIST)]),
                ],
                ["row", "n_words", "place", "fp", "size", "before", "around"],
            )

    kind = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {kind}, n_words long, place long, {FINGERPRINT}")


def words_sql(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', 0)"


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted).

    ``n_hit`` counts the words inside any occurrence of a window of any item.
    """
    found, prints, named = _found(docs, items, doc_id, text, item_id, item_text)
    return _resolve(found, prints, named).select(F.col("row.id").alias("doc_id"), "n_words", "n_hit", "items")


def without_items(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` in which no window of an item stands; each row is judged by its own text."""
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    resolved = _resolve(*_found(docs, items, **names)).where("n_hit > 0")
    hit = resolved.select(F.col("row.id").alias("_hit_id"), F.col("row.hash").alias("_hit_hash")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(text) == F.col("_hit_hash"))
    return docs.join(hit, same, "left_anti")


def _found(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of documents and of items, and the items' ids."""
    spark = docs.sparkSession
    # Items with the same words are one text of several ids.
    texts = items.select(
        F.col(item_id).cast("string").alias("item"),
        F.concat_ws(" ", F.expr(words_sql(f"`{item_text}`"))).alias("text"),
    ).where("text != ''")
    named = texts.withColumn("rep", F.sha2("text", 256))
    prints = staged(item_fingerprints(named.dropDuplicates(["rep"])), "item-prints")
    lengths = [r[0] for r in prints.where(f"size < {WINDOW}").select("size").distinct().collect()]
    bits = spark.sparkContext.broadcast(key_filter(prints, "fp"))

    # Rows are told apart by id and text, also where ids repeat or are null.
    row = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    source = docs.select(row.alias("row"), F.col(text).alias("text"))
    found = staged(document_fingerprints(source, bits, sorted(lengths)), "doc-prints")
    return found, prints, named


def _resolve(found: DataFrame, prints: DataFrame, named: DataFrame) -> DataFrame:
    hits = found.where("fp is not null").drop("n_words").distinct()
    other = prints.select(
        "rep", "fp", "size", F.col("before").alias("i_before"), F.col("around").alias("i_around")
    ).distinct()
    # A window may start up to WINDOW - K words before the fingerprint.
    starts = F.expr(
        f"""filter(sequence(0, if(size < {WINDOW}, 0, {WINDOW - K})),
        s -> s <= before and s <= i_before
        and slice(around, before - s + 1, size) = slice(i_around, i_before - s + 1, size)
        and size(slice(around, before - s + 1, size)) = size)"""
    )
    windows = (
        hits.join(other, ["fp", "size"])
        .withColumn("starts", starts)
        .where("size(starts) > 0")
        .select("row", "rep", "size", "place", F.explode("starts").alias("s"))
        .select("row", "rep", (F.col("place") - F.col("s")).alias("a"), "size")
        .distinct()
    )
    # Words covered: windows in order, each adding what lies beyond the end so far.
    spans = F.array_sort(F.collect_set(F.struct("a", (F.col("a") + F.col("size")).alias("b"))))
    covered = F.expr(
        """aggregate(spans, named_struct('n', 0L, 'e', 0L), (acc, x) -> named_struct(
        'n', acc.n + greatest(x.b - greatest(x.a, acc.e), 0L), 'e', greatest(acc.e, x.b)), acc -> acc.n)"""
    )
    hit = windows.groupBy("row").agg(spans.alias("spans")).select("row", covered.alias("n_hit"))
    lists = (
        windows.select("row", "rep")
        .distinct()
        .join(named.select("rep", "item").distinct(), "rep")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        found.where("n_words is not null")
        .select("row", "n_words")
        .join(hit, "row", "left")
        .join(lists, "row", "left")
        .select(
            "row",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def report(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return decontaminate(docs, items, **names).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        hex_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
