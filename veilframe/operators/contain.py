"""Which strings contain which others, and where, without comparing all pairs.

A needle lies only where all its q-grams are. The grams of the needles are counted in
the texts, and each needle is keyed by its rarest one (its anchor); a needle with a gram that
occurs nowhere is left out at once. Texts are then searched for anchors alone, and the few
pairs that meet are checked in full. So needles that begin alike, such as the
phone numbers of a group, do not meet every text of the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.shared import spread, staged

GRAM = 4
# Lengths of the grams that places in texts are looked up by: the longest that a needle allows.
GRAMS = (1, 2, 4, 8)
# Code points of a text that are cut up together.
BLOCK = 256
# At most this many grams are sent to every executor; more are joined by a shuffle.
BROADCAST_GRAMS = 500_000
# At most this many anchors, as numbers, are sent to every executor at once.
BROADCAST_ANCHORS = 2_000_000


def _grams(text: Column) -> Column:
    """Places (from 0) and grams of a needle; a shorter one is its own gram."""
    last = F.greatest(F.length(text) - GRAM, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("off"), F.substring(text, i + 1, F.lit(GRAM)).alias("gram")),
    )


def _spread(keys: DataFrame) -> DataFrame:
    """A table of keys to join with: sent to every executor if its size allows."""
    return F.broadcast(keys) if keys.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else keys


def _lengths(needles: DataFrame) -> list[int]:
    """Lengths of the grams that occur: at most GRAM numbers."""
    found = needles.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found)


def _pieces(text: Column, lengths: list[int]) -> Column:
    """Every piece of ``text`` of one of some lengths, and its place (from 0)."""

    def of(n: int) -> Column:
        last = F.length(text) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(text, i + 1, F.lit(n)).alias("gram")))

    return F.concat(*[of(n) for n in lengths])


def anchored(needles: DataFrame, pieces: DataFrame) -> DataFrame:
    """needles with ``off`` and ``gram``, the rarest gram in ``pieces`` (gram) and its place.

    Of equally rare ones the first is taken. Needles that cannot occur are left out.
    """
    each = needles.select("*", F.inline(_grams(F.col("needle"))))
    wanted = _spread(each.select("gram").distinct())
    counts = pieces.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rated = each.join(counts, "gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy(*needles.columns).agg(F.min(F.struct("_n", "off", "gram")).alias("_a"))
    return rarest.where("_a._n > 0").select(*needles.columns, "_a.off", "_a.gram")


def contained_in(needles: DataFrame, hays: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs (scope, needle, hay) with ``needle`` inside ``hay``; both distinct, no needle empty."""
    needles = needles.select(*scope, "needle").where(F.length("needle") > 0)
    lengths = _lengths(needles)
    if not lengths:
        return hays.limit(0).select(*scope, F.lit("").alias("needle"), "hay")
    pieces = hays.select(*scope, "hay", F.explode(F.array_distinct(_pieces(F.col("hay"), lengths)["gram"])).alias("gram"))
    keyed = anchored(needles, pieces.select("gram")).drop("off")
    near = pieces.join(_spread(keyed.select("gram").distinct()), "gram", "left_semi")
    met = near.join(keyed, [*scope, "gram"])
    return met.where(F.contains("hay", "needle")).select(*scope, "needle", "hay")


def _keyed(needles: DataFrame, scope: list[str]) -> DataFrame:
    """needles with ``off`` and ``gram``: the gram that fewest needles of their scope have, the first of such.

    Grams are as long as the needle allows, up to the last of GRAMS. So a piece of a text meets few needles
    however many there are, and the texts need not be counted first.
    """
    n = F.lit(GRAMS[0])
    for longer in GRAMS[1:]:
        n = F.when(F.length("needle") >= longer, longer).otherwise(n)
    places = F.sequence(F.lit(0), F.length("needle") - n)
    grams = F.transform(places, lambda i: F.struct(i.alias("off"), F.substring("needle", i + 1, n).alias("gram")))
    each = needles.select("*", F.inline(grams))
    counts = each.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("_n"))
    rated = each.join(counts, [*scope, "gram"])
    rarest = rated.groupBy(*needles.columns).agg(F.min(F.struct("_n", "off", "gram")).alias("_a"))
    return rarest.select(*needles.columns, "_a.off", "_a.gram")


def occurrences(texts: DataFrame, needles: DataFrame, scope: list[str]) -> DataFrame:
    """Every place where a needle of the scope stands in a text.

    ``texts`` has scope, key columns and ``text``; ``needles`` has scope, ``needle`` and
    whatever should travel with it. Adds ``st`` (from 0), ``ln``. Long texts are cut into
    blocks with as much text around them as the longest needle needs; a place goes
    into the shuffle only if an anchor stands there, with no more text than the longest needle takes.
    More anchors than executors can hold are looked up in several passes over the texts.
    """
    needles = needles.where(F.length("needle") > 0)
    keys = [c for c in texts.columns if c != "text"]
    keyed = staged(_keyed(needles, scope), "anchors")
    found = keyed.agg(
        F.max(F.length("needle")).alias("longest"), F.collect_set(F.length("gram")).alias("lengths"),
        F.approx_count_distinct(F.xxhash64(*scope, "gram")).alias("anchors"),
    ).first()
    if found["longest"] is None:
        none = texts.limit(0).select(*keys, F.lit(0).alias("st"), F.lit(0).alias("ln"))
        return none.join(needles.limit(0), scope)
    longest = found["longest"]
    block = max(BLOCK, 2 * longest)

    def part(k: Column) -> Column:
        base = k * block
        start = F.greatest(base - longest, F.lit(0))
        around = F.substring(F.col("text"), start + 1, base - start + block + longest + GRAMS[-1])
        return F.struct(base.alias("base"), start.alias("start"), around.alias("around"))

    last = F.floor((F.length("text") - 1) / block).cast("int")
    parts = spread(texts.where(F.length("text") > 0)).select(
        *keys, F.inline(F.transform(F.sequence(F.lit(0), last), part))
    )

    def pieces(n: int) -> Column:
        # Grams that begin in the block itself; what stands around it belongs to its neighbours.
        first = F.col("base") - F.col("start")
        until = F.least(F.length("around") - n, first + block - 1)
        places = F.when(until >= first, F.sequence(first, until)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring("around", i + 1, F.lit(n)).alias("gram")))

    every = F.concat(*[pieces(n) for n in sorted(found["lengths"])])
    cut = parts.select(*keys, "start", "around", F.inline(every)).withColumn("_h", F.xxhash64(*scope, "gram"))
    passes = -(-found["anchors"] // BROADCAST_ANCHORS)
    # Places count from the text's beginning from here on.
    at, begin = F.col("start") + F.col("at"), F.greatest(F.col("at") - longest, F.lit(0))
    near = []
    for i in range(passes):
        anchors = keyed.select(F.xxhash64(*scope, "gram").alias("_h")).where(F.pmod("_h", F.lit(passes)) == i)
        here = cut.join(F.broadcast(anchors.distinct()), "_h", "left_semi").select(
            *keys, "gram", at.alias("at"), (F.col("start") + begin).alias("start"),
            F.substring("around", begin + 1, F.col("at") - begin + longest + GRAMS[-1]).alias("around"),
        )
        # Written one after the other, so the driver and the executors hold the anchors of one pass at a time.
        near.append(staged(here, "places") if passes > 1 else here)
    near = reduce(DataFrame.unionByName, near)
    met = near.join(keyed, [*scope, "gram"]).withColumns({"st": F.col("at") - F.col("off"), "ln": F.length("needle")})
    stands = F.substring("around", F.col("st") - F.col("start") + 1, F.col("ln")) == F.col("needle")
    return met.where((F.col("st") >= 0) & stands).drop("start", "around", "at", "off", "gram")
