"""Mix sources to target weights by a low-discrepancy schedule.

Each source is a shuffled stream of words, cut into blocks of equal length. Slots
are numbered; slot j is a point of a golden-ratio sequence in [0, 1), and the
source whose share of the unit interval holds the point gets the slot. The r-th
slot of a source takes its r-th block, and starts the stream anew after the last one.
Any stretch of the schedule thereby holds the sources close to their shares.

A source takes its target to the word: slots beyond it are left out, its last slot
is cut, and what the sequence left short is taken after the last slot. At most two
passes are made over a source, so no document is taken more than twice.

Only DataFrame operations; sums over a source run over blocks of its stream and
then over the blocks, so that no task holds a whole source.

Edge cases: a null text has no words, and a document without words takes nothing;
null is a source of its own, the last one; repeated rows are documents of their
own; without documents or words the result is empty or all zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import running_total, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1024
# Documents of one source that are put in order in one task.
STREAM_ROWS = 8192
# Golden-ratio steps in whole numbers: point j is j * STEP modulo POINTS.
POINTS = 1 << 31
STEP = 1327217885
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """doc_id, source, size and a shuffle key of each document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        size.alias("size"), key.alias("key"),
    )


def targets(
    sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, docs, target, words: how much each source gives to the mix.

    A source gets its weight's part of what the capped ones leave, until none
    is above ``most`` times its size.
    """
    # Rank by range partition and row inside it: no task sees all sources.
    spark = sources.sparkSession
    parted = staged(
        sources.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn(
            "part", F.spark_partition_id().cast("long")
        ),
        "mix-sources",
    )
    ranked = running_total(
        parted.withColumn("all", F.lit(0)), ["all"], "part",
        [F.col("source").asc_nulls_last()], F.lit(1), "place",
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = staged(
        ranked.select("source", "source_size", "docs", weight.alias("weight")), "mix-weights"
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    cap = F.col("source_size") * F.lit(most)
    # One round for each time that a source is found above its cap; each reads one row.
    while True:
        free = F.col("weight") * F.lit(level) <= cap
        row = weighted.agg(
            F.sum(F.when(free, 0.0).otherwise(cap)).alias("capped"),
            F.sum(F.when(free, F.col("weight")).otherwise(0.0)).alias("weight"),
            F.sum(F.when(free, 0).otherwise(1)).alias("n"),
        ).first()
        if not row["weight"] or row["n"] == before:
            break
        before, level = row["n"], (share * total - row["capped"]) / row["weight"]
    out = weighted.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
    words = F.least(F.floor(F.col("target") + 0.5), F.floor(cap)).cast("long")
    return out.select("source", "source_size", "docs", "target", words.alias("words"))


def streams(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """Documents with ``at``, their first word's place in the shuffled stream of their source."""
    # As many ranges of the shuffle key as give each about STREAM_ROWS documents.
    ranges = F.greatest(F.lit(1), F.ceil(F.col("docs") / STREAM_ROWS)).cast("long")
    part = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 28)))
    plan = goal.select(F.col("source").alias("s"), ranges.alias("ranges"))
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", part).drop("s", "ranges")
    return running_total(
        rows, ["source"], "part", ["key", "doc_id", "size"], F.col("size"), "at"
    )


def schedule(goal: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, rank, first word and end word in the repeated stream."""
    spark = goal.sparkSession
    total = goal.agg(F.sum("words")).first()[0] or 0
    slots = -(-total // block_words)
    # Shares of the unit interval, in whole points.
    edges = running_total(
        goal.where("words > 0").withColumn("all", F.lit(0)).withColumn("part", F.lit(0)),
        ["all"], "part", [F.col("source").asc_nulls_last()], F.col("words"), "low",
    )
    point = lambda c: F.floor(c / F.lit(float(max(total, 1))) * F.lit(float(POINTS))).cast("long")
    edges = edges.select(
        "source", "source_size", "words",
        point(F.col("low")).alias("a"), point(F.col("low") + F.col("words")).alias("b"),
    )
    # Points and shares meet in cells, so that the range join is an equality join.
    width = POINTS // CELLS
    cells = F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width)))
    shares = edges.where("b > a").withColumn("cell", cells)
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") % POINTS) * STEP % POINTS).alias("u")
    ).withColumn("cell", F.floor(F.col("u") / width))
    met = points.join(shares, "cell").where("u >= a and u < b")
    ranked = running_total(
        met.withColumn("part", F.floor(F.col("slot") / 65536)), ["source"], "part",
        ["slot"], F.lit(1), "rank",
    ).select("slot", "source", "rank")
    # What the sequence gives a source too few of follows after the last slot.
    given = ranked.groupBy("source").agg(F.count("*").alias("given"))
    need = goal.where("words > 0").select(
        F.col("source").alias("s"), "source_size", "words",
        F.ceil(F.col("words") / block_words).alias("blocks"),
    )
    short = (
        need.join(given, F.col("s").eqNullSafe(F.col("source")), "left")
        .where("coalesce(given, 0) < blocks")
        .select(
            F.lit(slots).alias("slot"), F.col("s").alias("source"),
            F.explode(F.sequence(F.coalesce("given", F.lit(0)), F.col("blocks") - 1)).alias("rank"),
        )
    )
    begin = F.col("rank") * block_words
    return (
        ranked.unionByName(short)
        .join(need, F.col("source").eqNullSafe(F.col("s")))
        .where(F.col("rank") < F.col("blocks"))
        .select(
            "slot", "source", "rank", "source_size", begin.alias("first"),
            F.least(begin + block_words, F.col("words")).alias("end"),
        )
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(streams, goal, pieces): documents in stream order, targets, and what each slot takes.

    A piece is the part of a document, in words from 0, that one slot takes.
    """
    sizes = staged(sized(docs, doc_id, source, text), "mix-sizes")
    goal = staged(
        targets(
            sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")),
            weights, share, most,
        ),
        "mix-goal",
    )
    stream = staged(streams(sizes, goal), "mix-stream")
    slots = schedule(goal, block_words)
    # A slot's words in one pass of the stream; the one over the end is two ranges.
    span = F.expr(
        "filter(transform(sequence(first div source_size, (end - 1) div source_size), e -> named_struct("
        "'epoch', e, 'a', greatest(first - e * source_size, 0), 'b', least(end - e * source_size, source_size))), "
        "x -> x.b > x.a)"
    )
    ranges = slots.select("slot", "source", "rank", F.explode(span).alias("r")).select(
        "slot", "source", "rank", "r.epoch", "r.a", "r.b",
        F.explode(F.sequence(F.floor(F.col("r.a") / block_words), F.floor((F.col("r.b") - 1) / block_words))).alias("block"),
    )
    # Documents meet slots in blocks of the stream.
    placed = stream.where("size > 0").select(
        F.col("source").alias("s"), "doc_id", "size", "key", "at",
        F.explode(
            F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))
        ).alias("own"),
    )
    low = F.greatest("a", "at", F.col("block") * block_words)
    high = F.least("b", F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = (
        ranges.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("own")))
        .select("slot", "source", "rank", "epoch", "doc_id", "key", "size", "at",
                (low - F.col("at")).alias("begin"), (high - F.col("at")).alias("end"))
        .where("end > begin")
    )
    return stream, goal, pieces


def report(docs: DataFrame, **names) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    stream, goal, pieces = mix(docs, **names)
    by = ["source", "key", "at"]
    taken = pieces.groupBy(*by).agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in by], "taken")
    # A document's place in its stream is its own, unless it has no words.
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in by] + [F.col("size") > 0]
    plan = goal.select(F.col("source").alias("g"), "source_size", "target")
    return (
        stream.join(taken, same, "left")
        .join(plan, F.col("source").eqNullSafe(F.col("g")))
        .select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
