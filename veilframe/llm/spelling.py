"""Spelling variants: words of a corpus grouped with the far more frequent word one edit away.

Words are marked with a terminator and rotated (a permuterm). The rotation that puts code
point c of a word last is y$x + c, where the word is xcy. All words that differ from it by
replacing c share the prefix y$x, and the word xy, which lacks c, has that prefix as a whole
rotation. So with all rotations sorted, each prefix is a range holding the words that differ
in the skipped place, the shorter one first. One scan tells every word how many
neighbours it has in the range and which is the most frequent; pairs are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import staged

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Where the contract deletes a code point.
ONE_IN = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
# Must not occur in a word.
TERMINATOR = "$"
# A digest stands for the prefix of a longer word: only equal prefixes need to meet.
LONG = 64
WHOLE, MEMBER, REPEATED = 0, 1, 2
FOUND = "word string, near long, best_n long, best string"


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of at least six code points that occur at least five times.

    Words are maximal runs of letters, A-Z in lower case. Where 199 divides the CRC-32 h of
    ``<key>:<run>``, code point h % length is left out first. A null text has no words, a
    null key counts as an empty one. Counts are combined before the shuffle.
    """
    # A run of fewer letters cannot become a word; leaving one out makes it shorter still.
    pattern = f"[{LETTERS}]{{{LEAST_LENGTH},}}"
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"),
        F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("_run"),
    ).select("_key", F.translate("_run", UPPER, LOWER).alias("_run"))
    h = F.crc32(F.concat("_key", F.lit(":"), "_run"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    word = F.when(F.col("_h") % ONE_IN == 0, shorter).otherwise(F.col("_run"))
    words = runs.withColumn("_h", h).select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, kind, n, word: what every rotation of every word begins with.

    ``WHOLE``: the word's own whole rotations. Else the last code point is skipped; it is
    ``REPEATED`` if the one before it in the word is the same, so that leaving out either
    of the two, which gives one and the same word, counts once.
    """

    def prefix(i: Column, rest: int) -> Column:
        text = F.concat(
            F.substring("word", i + rest, F.length("word")), F.lit(TERMINATOR), F.substring("word", F.lit(1), i)
        )
        return F.when(F.length(text) > LONG, F.concat(F.lit("#"), F.md5(text))).otherwise(text)

    def skipped(i: Column) -> Column:
        same = (i > 0) & (F.substring("word", i + 1, F.lit(1)) == F.substring("word", i, F.lit(1)))
        return F.struct(prefix(i, 2).alias("prefix"), F.when(same, REPEATED).otherwise(MEMBER).alias("kind"))

    length = F.length("word")
    whole = F.transform(
        F.sequence(F.lit(0), length), lambda i: F.struct(prefix(i, 1).alias("prefix"), F.lit(WHOLE).alias("kind"))
    )
    one_out = F.transform(F.slice(F.sequence(F.lit(0), length), F.lit(1), length), skipped)
    return words.select(F.inline(F.concat(whole, one_out)), "n", "word")


def _scan_groups(rows: pa.Table) -> pa.RecordBatch | None:
    """What the members of each prefix learn of one another; rows come sorted, groups whole."""

    def starts(of: pa.Table) -> np.ndarray:
        prefix = of.column("prefix").combine_chunks()
        new = np.ones(len(of), dtype=bool)
        if len(of) > 1:
            new[1:] = pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    start = starts(rows)
    size = np.diff(np.append(start, len(rows)))
    rows = rows.filter(pa.array(np.repeat(size > 1, size)))
    if not len(rows):
        return None
    size = size[size > 1]
    start = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(rows))
    kind, n = rows.column("kind").to_numpy(), rows.column("n").to_numpy()
    has_whole = kind[start] == WHOLE
    members, first = size - has_whole, start + has_whole
    member = kind != WHOLE
    # Members replace one code point of one another; the first is the most frequent.
    who = at[member & (members[group] > 1)]
    best = np.where(who == first[group[who]], who + 1, first[group[who]])
    near = members[group[who]] - 1
    # The whole rotation is a member with one code point left out.
    long = at[(kind == MEMBER) & has_whole[group]]
    short, where, count = np.unique(group[long], return_index=True, return_counts=True)
    who = np.concatenate([who, long, start[short]])
    best = np.concatenate([best, start[group[long]], long[where]])
    near = np.concatenate([near, np.ones(len(long), np.int64), count])
    if not len(who):
        return None
    words = rows.column("word").combine_chunks()
    columns = [words.take(pa.array(who)), pa.array(near.astype(np.int64)), pa.array(n[best]), words.take(pa.array(best))]
    return pa.RecordBatch.from_arrays(columns, ["word", "near", "best_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take whole groups from the sorted rows; the last one of a batch may go on in the next."""
    left: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
        if not len(rows):
            continue
        prefix = rows.column("prefix").combine_chunks()
        same = pc.equal(prefix, prefix[len(prefix) - 1]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))
        left = rows.slice(cut)
        if cut and (found := _scan_groups(rows.slice(0, cut))) is not None:
            yield found
    if left is not None and (found := _scan_groups(left)) is not None:
        yield found


def neighbours(words: DataFrame) -> DataFrame:
    """word, n, n_near and ``best`` (struct of -n and word): the words one edit away.

    ``words`` has each word once, with n. A word without neighbours stays, with none.
    """
    turned = rotations(words)
    order = ["prefix", F.col("kind") != WHOLE, F.col("n").desc(), "word"]
    found = turned.repartitionByRange("prefix").sortWithinPartitions(*order).mapInArrow(_scan, FOUND)
    none = words.select("word", "n", *[F.lit(None).cast(t).alias(c) for c, t in (("near", "long"), ("best_n", "long"), ("best", "string"))])
    told = found.withColumn("n", F.lit(None).cast("long")).unionByName(none)
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word")))
    return told.groupBy("word").agg(
        F.max("n").alias("n"), F.coalesce(F.sum("near"), F.lit(0)).alias("n_near"), F.min(best).alias("best")
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with ``root``, the last word that forms lead to.

    Each round doubles the steps taken and goes on with words not at their root alone.
    Counts grow along a way, so a way has an end and few rounds are needed: a form occurs
    five times as often as its word.
    """
    steps = staged(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    ended = steps.limit(0)
    left = steps
    while not left.isEmpty():
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("_beyond"))
        # `steps` leads 2^k forms on in round k, and so does each word that is left.
        tried = staged(left.join(beyond, "root", "left"), "roots")
        ended = ended.unionByName(tried.where("_beyond IS NULL").select("word", "root"))
        left = tried.where("_beyond IS NOT NULL").select("word", F.col("_beyond").alias("root"))
        steps = ended.unionByName(left)
    return forms.join(ended, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n from words with their counts.

    Two words are near if one inserted, deleted or replaced code point makes them equal. A
    word's form is the most frequent of its near words (the smallest, if several are), if
    that occurs five times as often as the word, else null. ``root`` follows the forms to
    the last word and is the word itself where there is no form. No words: no rows.
    """
    near = neighbours(words)
    taken = -F.col("best.m") >= TIMES * F.col("n")
    forms = near.select(
        "word",
        F.when(taken, F.col("best.word")).alias("form"),
        "n",
        "n_near",
        F.when(taken, -F.col("best.m")).alias("form_n"),
    )
    return with_roots(staged(forms, "spelling")).select("word", "form", "root", "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """Words of the texts of docs with their variants; columns other than id and text are not looked at."""
    return variants(staged(word_counts(docs.select("doc_id", "text")), "words"))
