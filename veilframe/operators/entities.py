"""The entity table: one row per distinct value of a group, with its token.

Columns: group_id, norm, ty, original, token, n, doc_seq, unit_no, pass, nst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Entities of up to this many consecutive texts are numbered by one window.
_LEAF_BITS = 16
_FANOUT_BITS = 16


def mentions(units: DataFrame, spans: str) -> DataFrame:
    """One row per span; ``spans`` is the expression that gives a unit's spans.

    """
    return units.select(
        "group_id", "doc_seq", "unit_no", F.explode(F.expr(spans)).alias("s")
    ).select("group_id", "doc_seq", "unit_no", "s.*")


def arrival(left_to_right: bool = False) -> list[Column]:
    """Order in which values of a group are met.

    Texts come in order, the first pass before the second; within a pass the
    last span of a text is met first unless asked otherwise.
    """
    st = F.col("st") if left_to_right else -F.col("st")
    return [F.col("doc_seq"), F.col("unit_no"), F.col("pass"), st.alias("nst")]


def first_mentions(found: DataFrame, left_to_right: bool = False) -> DataFrame:
    """The first mention of each value; its spelling and type stand for all.

    A minimum, so a value that fills a third of all rows is folded before the
    shuffle and costs no more than a rare one.
    """
    order = arrival(left_to_right)
    first = F.min(F.struct(*order, "ty", F.col("v").alias("original"))).alias("f")
    return found.groupBy("group_id", "norm").agg(first).select("group_id", "norm", "f.*")


def with_ordinals(
    df: DataFrame, keys: list[str], seq: str, tie: list[str], name: str = "n"
) -> DataFrame:
    """``row_number`` per ``keys`` that no single group can overload."""
    return with_running_total(df, keys, seq, tie, F.lit(1).cast("bigint"), name)


def with_running_total(
    df: DataFrame, keys: list[str], seq: str, tie: list[str], value: Column, name: str
) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in the order of ``seq`` and ``tie``.

    Rows are summed inside blocks of ``seq``; the block totals are then summed up
    in two more levels. No window holds more than one block, however many rows
    share the keys. Blocks follow from the values alone, so a recomputed task
    gives the same sums. ``seq`` is a non-negative arrival number.
    """
    blocked = df.withColumn("_v", value).withColumn("_leaf", F.shiftright(seq, _LEAF_BITS))
    leaf = (
        Window.partitionBy(*keys, "_leaf")
        .orderBy(seq, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = blocked.withColumn("_i", F.sum("_v").over(leaf)).drop("_v")

    sizes = (
        blocked.groupBy(*keys, "_leaf")
        .agg(F.sum("_v").alias("_c"))
        .withColumn("_top", F.shiftright("_leaf", _FANOUT_BITS))
    )
    before_leaf = _sum_before([*keys, "_top"], "_leaf")
    tops = sizes.groupBy(*keys, "_top").agg(F.sum("_c").alias("_c"))
    tops = tops.select(*keys, "_top", _sum_before(keys, "_top").alias("_b"))
    offsets = (
        sizes.withColumn("_a", before_leaf)
        .join(tops, [*keys, "_top"])
        .select(*keys, "_leaf", (F.col("_a") + F.col("_b")).alias("_before"))
    )
    return (
        inside.join(offsets, [*keys, "_leaf"])
        .withColumn(name, F.col("_before") + F.col("_i"))
        .drop("_leaf", "_i", "_before")
    )


def _sum_before(keys: list[str], order: str) -> Column:
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum("_c").over(earlier), F.lit(0))


def tag(ty: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), ty, F.lit("_"), n.cast("string"), F.lit(">"))


def number_entities(first: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Number new values per group and type, going on after ``existing`` ones.

    ``existing`` (group_id, norm, ty, token, original) comes from earlier runs
    of the same groups; one run may write a group at a time.
    """
    tie = ["unit_no", "pass", "nst"]
    if existing is None:
        return with_ordinals(first, ["group_id", "ty"], "doc_seq", tie)
    fresh = first.join(existing.select("group_id", "norm"), ["group_id", "norm"], "left_anti")
    # Maps may have gaps, so the highest number counts; stand-ins carry none and are counted.
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(token, r'^<[A-Z][A-Z_]*_([0-9]+)>$', 1) as bigint)"), F.lit(0))
    taken = existing.groupBy("group_id", "ty").agg(
        F.greatest(F.count(F.lit(1)), F.max(number)).alias("_taken")
    )
    return (
        with_ordinals(fresh, ["group_id", "ty"], "doc_seq", tie)
        .join(taken, ["group_id", "ty"], "left")
        .withColumn("n", F.col("n") + F.coalesce("_taken", F.lit(0)))
        .drop("_taken")
    )


def tagged(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn("token", tag(F.col("ty"), F.col("n")))


def known_values(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Entities of earlier runs that this run meets again."""
    return existing.join(
        found.select("group_id", "norm").distinct(), ["group_id", "norm"], "left_semi"
    )


def last_written(maps: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Merge token maps: of several originals of a token the last written wins."""
    return maps.groupBy(*scope, "token").agg(
        F.max_by("original", F.struct(*order)).alias("original")
    )


def own_token_guard(values: DataFrame, tokens: DataFrame, scope: str = "group_id") -> DataFrame:
    """Drop second-pass values that occur inside a token of their scope.

    Values meet tokens on their leading characters, never all with all.
    """
    from veilframe.operators.contain import contained_in

    inside = contained_in(
        values.select(scope, F.col("v").alias("needle")).distinct(),
        tokens.select(scope, F.col("token").alias("hay")).distinct(),
        [scope],
    )
    return values.join(
        inside.select(scope, F.col("needle").alias("v")).distinct(), [scope, "v"], "left_anti"
    )
