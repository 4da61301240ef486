"""Document fingerprints by consistent weighted sampling, with DataFrame operations only.

A text is a bag of weighted terms: its words between white space, in lower case, weighing as
often as they occur. Sample k of a term with weight S draws r and c from Gamma(2, 1) and b
from U(0, 1), all from a hash of the term and k alone. With t = floor(ln S / r + b) the term
scores c * exp(-r * (t - b + 1)), and the smallest score of a text is its sample k. Two texts
have equal samples with a chance that is their generalised Jaccard similarity: the sum of the
smaller weights of all terms over the sum of the larger ones. A score names its term and t,
so a hash of the smallest one stands for the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import fresh_path, staged

SAMPLES = 64
SAMPLE_BLOCK = 16
# A third of the rows may be copies of one row; they are given out in pieces of this many.
PIECE = 1_000


def _unit(bits: Column, width: int) -> Column:
    """A number between 0 and 1, both left out, from the lowest bits."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) / float(1 << width)


def _score(term: Column, log_weight: Column, block: Column, j: int) -> Column:
    """What sample j of a block says of a term; the smallest over a text is taken."""
    one = F.xxhash64(term, block, F.lit(2 * j))
    two = F.xxhash64(term, block, F.lit(2 * j + 1))
    r = -F.log(_unit(one, 32) * _unit(F.shiftrightunsigned(one, 32), 32))
    c = -F.log(_unit(two, 21) * _unit(F.shiftrightunsigned(two, 21), 21))
    b = _unit(F.shiftrightunsigned(two, 42), 22)
    return c * F.exp(r * (b - F.floor(log_weight / r + b) - 1))


def least_scores(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and ``scores`` (array of doubles) from rows of keys, ``term`` (long) and ``weight``.

    Terms of one key must differ. A null term, or a weight that is null or not above zero,
    counts for nothing; a key with nothing else has nulls. Scores of a key whose terms come
    in several parts are the least ones of the parts.
    """
    weight = F.when(F.col("term").isNotNull() & (F.col("weight") > 0), F.log(F.col("weight").cast("double")))
    # Few samples at a time: the code that is generated for many is too long to be compiled well.
    blocks = F.array(*[F.lit(b) for b in range(-(-samples // SAMPLE_BLOCK))])
    each = terms.select(*keys, "term", weight.alias("_log"), F.explode(blocks).alias("_block"))
    least = [F.min(_score(F.col("term"), F.col("_log"), F.col("_block"), j)).alias(f"_{j}") for j in range(SAMPLE_BLOCK)]
    best = each.groupBy(*keys, "_block").agg(*least)
    parts = best.select(*keys, F.struct("_block", F.array(*[F.col(f"_{j}") for j in range(SAMPLE_BLOCK)]).alias("s")).alias("_part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["s"]))
    return parts.groupBy(*keys).agg(F.slice(whole, 1, samples).alias("scores"))


def fingerprint(scores: Column) -> Column:
    """Sixteen bits of hash for each score, in two bytes; empty where there was no term."""
    digits = F.transform(scores, lambda x: F.lpad(F.hex(F.pmod(F.xxhash64(x), F.lit(1 << 16))), 4, "0"))
    return F.when(scores[0].isNull(), F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(digits, "")))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two texts without words are alike, one without is like no other."""
    pairs = F.sequence(F.lit(1), F.lit(2 * samples - 1), F.lit(2))
    same = lambda n, i: n + (F.substring(a, i, F.lit(2)) == F.substring(b, i, F.lit(2))).cast("int")
    equal = F.aggregate(pairs, F.lit(0), same)
    empty = F.unhex(F.lit(""))
    return F.when((a == empty) | (b == empty), (a == b).cast("double")).otherwise(equal / samples)


def weighted_samples(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and ``fingerprint`` (binary) of weighted terms, as least_scores() takes them."""
    best = least_scores(terms, keys, samples)
    return best.select(*keys, fingerprint(F.col("scores")).alias("fingerprint"))


def _word_weights(texts: DataFrame, keys: list[str], variants: int) -> DataFrame:
    """keys, ``term`` and how often it occurs in each variant: ``_w0``, ``_w1`` and so on.

    texts has keys, ``_which`` (the number of the variant) and ``_text``. Words are runs of
    characters other than white space, in lower case. Each text has at least one row; its
    term is null if it has no word.
    """
    words = texts.select(*keys, "_which", F.explode(F.split(F.lower("_text"), "[\\x20\\x09-\\x0D]+")).alias("_word"))
    term = F.when(F.col("_word") != "", F.xxhash64("_word")).alias("term")
    counts = [F.sum((F.col("_which") == i).cast("int")).alias(f"_w{i}") for i in range(variants)]
    return words.select(*keys, "_which", term).groupBy(*keys, "term").agg(*counts)


def variant_samples(texts: DataFrame, keys: list[str], variants: int, samples: int = SAMPLES) -> DataFrame:
    """keys and a fingerprint for each variant of a text (``_print0`` ...), null where there is none.

    A term that weighs the same in several variants is scored once for all of them.
    """
    weights = [F.col(f"_w{i}") for i in range(variants)]

    def share(i: int) -> Column:
        """The variants from i on where the term weighs as in i, as bits; null if an earlier one did."""
        seen = F.lit(False)
        for w in weights[:i]:
            seen = seen | (w == weights[i])
        bits = sum((F.when(w == weights[i], 1 << j).otherwise(0) for j, w in enumerate(weights[i:], i)), F.lit(0))
        return F.struct(F.when((weights[i] > 0) & ~seen, bits).alias("_share"), weights[i].alias("weight"))

    shares = F.filter(F.array(*[share(i) for i in range(variants)]), lambda x: x["_share"].isNotNull())
    terms = _word_weights(texts, keys, variants).select(*keys, "term", F.inline(shares))
    parts = least_scores(terms, [*keys, "_share"], samples)
    # At most one part for each set of variants.
    whole = parts.groupBy(*keys).agg(F.collect_list(F.struct("_share", "scores")).alias("_parts"))

    def of(i: int) -> Column:
        own = F.filter("_parts", lambda p: p["_share"].bitwiseAND(1 << i) != 0)
        both = lambda x, y: F.zip_with(x, y["scores"], lambda u, v: F.least(u, v))
        rest = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0)))
        found = F.aggregate(rest, F.try_element_at(own, F.lit(1))["scores"], both)
        return F.when(F.size(own) > 0, fingerprint(found))

    return whole.select(*keys, *[of(i).alias(f"_print{i}") for i in range(variants)])


# A row is known by hashes of its id and its text: never null, and equal rows share them.
OWN = ["_doc", "_hash"]


def in_a_ring(rows: DataFrame) -> DataFrame:
    """_id, _doc, _hash, _half, _copies and the key (_next_doc, _next_hash) of the document that follows.

    Order: descending id, no id last; different texts of one id by hash; the first follows
    the last. Keys are ranged over the cluster, the rows inside a range are put in order
    there, and only the head of each range meets the others, so no task sees all of them.
    """
    spark = rows.sparkSession
    order = [F.col("_id").desc_nulls_last(), F.col("_hash")]
    keys = rows.groupBy("_id", *OWN, "_half").agg(F.count(F.lit(1)).alias("_copies"))
    path = fresh_path(spark, "ring")
    # Written, because the ranges are sampled and must not change between two readers.
    ranged = keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    inner = Window.partitionBy("_range").orderBy(*order)
    key = F.struct(*OWN)
    chained = ranged.select("*", F.lead(key).over(inner).alias("_next"), F.row_number().over(inner).alias("_n"))
    heads = chained.where("_n = 1").select("_range", key.alias("_head"))
    ahead = Window.orderBy("_range")
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_head").over(ahead), F.first("_head").over(whole))
    following = F.coalesce("_next", "_after")
    return chained.join(heads.select("_range", after.alias("_after")), "_range").select(
        "_id", *OWN, "_half", "_copies", following["_doc"].alias("_next_doc"), following["_hash"].alias("_next_hash")
    )


def fingerprints_of_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: the fingerprint of its text and of an edited one, and how alike they are.

    The last half (rounded down) of the text gives way to the first as many code points of
    the next document, or all it has. ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    A null text is empty; a text without words has an empty fingerprint. The next document
    is that of in_a_ring(): no id comes last, and a row that is there m times follows itself
    m - 1 times. A document alone is its own next. An empty table gives no rows. Other
    columns of docs are not looked at.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        "_id", F.xxhash64("_id").alias("_doc"), F.xxhash64("_text").alias("_hash"), "_text"
    )
    half = F.expr("cast(floor(length(_text) / 2) as int)")
    ring = in_a_ring(plain.select("_id", *OWN, half.alias("_half")))
    texts = plain.groupBy(*OWN).agg(F.first("_text").alias("_text"))

    def of_next(values: DataFrame, *wanted: Column) -> DataFrame:
        """For each document, what ``wanted`` says of the next one's row in values."""
        there = values.withColumnsRenamed({"_doc": "_next_doc", "_hash": "_next_hash"})
        return ring.join(there, ["_next_doc", "_next_hash"]).select(*OWN, *wanted)

    # The next text moves, cut to what is needed; the document's own stays where its key is.
    begin = F.expr("substring(_text, 1, _half)").alias("_begin")
    joined = texts.join(of_next(texts, "_id", "_copies", begin), OWN)
    kept = F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 2) as int))")
    edited = joined.select(
        *OWN,
        "_id",
        "_copies",
        F.col("_text").alias("_0"),
        F.concat(kept, "_begin").alias("_1"),
        F.when(F.col("_copies") > 1, F.concat(kept, F.substring("_text", F.lit(1), half))).alias("_2"),
    )
    # 0: the text itself, 1: edited with the next document's, 2: with its own, where it follows itself.
    variants = 2 if ring.where("_copies > 1").isEmpty() else 3
    which = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(f"_{i}").alias("_text")) for i in range(variants)])
    each = edited.select(*OWN, F.inline(F.filter(which, lambda x: x["_text"].isNotNull())))
    printed = variant_samples(each, OWN, variants, samples)
    if variants == 2:
        printed = printed.withColumn("_print2", F.lit(None).cast("binary"))
    facts = edited.select(
        *OWN,
        "_id",
        F.length("_0").cast("long").alias("n_chars"),
        F.unhex(F.sha2("_1", 256)).alias("_sha1"),
        F.unhex(F.sha2("_2", 256)).alias("_sha2"),
    )
    done = staged(printed.join(facts, OWN), "fingerprints", tidy=True)

    result = done.join(of_next(done, "_copies", F.col("_print0").alias("_print3")), OWN)
    # One row is followed by the next document, the copies before it by one another.
    pieces = F.expr(f"sequence(0, cast(ceil((_copies - 1) / {PIECE}) as int))")
    result = result.withColumn("_piece", F.explode(pieces))
    rest = F.least(F.lit(PIECE), F.col("_copies") - 1 - (F.col("_piece") - 1) * PIECE).cast("int")
    one = F.col("_piece") == 0
    result = result.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(one, 1).otherwise(rest))))
    edit = F.when(one, F.col("_print1")).otherwise(F.col("_print2"))
    return result.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        F.lower(F.hex(F.when(one, F.col("_sha1")).otherwise(F.col("_sha2")))).alias("edited_sha256"),
        F.lower(F.hex("_print0")).alias("fingerprint"),
        F.lower(F.hex(edit)).alias("edited_fingerprint"),
        likeness(F.col("_print0"), edit, samples).alias("near_edited"),
        F.when(one, likeness(F.col("_print0"), F.col("_print3"), samples)).otherwise(1.0).alias("near_next"),
    )
