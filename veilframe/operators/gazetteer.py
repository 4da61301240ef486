"""Names from a list: word sequences of a text looked up by an equi-join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.text import let
from veilframe.operators.patterns import SECOND_THRESHOLD
from veilframe.shared import spread

# A mark that ends a phrase counts as a word of its own, so no name reaches over it.
WORD = S.HARD_STOP + r"|[\p{L}\p{N}][\p{L}\p{N}_#'’-]*"
# A list of at most this many forms is sent to every executor.
BROADCAST_ROWS = 1_000_000
# Confidence of the three kinds of names; fixed values.
SCORES = {"PERSON": 0.95, "RU_ORGANIZATION": 0.90, "RU_LOCATION": 0.90}


def _sequences(text: str, longest: int) -> str:
    """Runs of 1 to ``longest`` words with their offsets in the text."""
    none = "cast(array() as array<struct<st:int,ln:int,form:string>>)"

    def of_length(n: int) -> str:
        last = f"w[i + {n - 2}]"
        run = (
            f"named_struct('st', w[i - 1].st, 'ln', {last}.st + {last}.ln - w[i - 1].st, "
            f"'form', lower(concat_ws(' ', transform(slice(w, i, {n}), x -> x.v))))"
        )
        starts = f"sequence(1, size(w) - {n - 1})"
        return f"if(size(w) >= {n}, transform({starts}, i -> {run}), {none})"

    every = ", ".join(of_length(n) for n in range(1, longest + 1))
    return let(S.find_all(text, WORD), "w", f"flatten(array({every}))")


def small_enough(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``table`` has at most ``rows`` rows; reads no more than it must."""
    return table.limit(rows + 1).count() <= rows


def gazetteer_spans(
    units: DataFrame,
    gazetteer: DataFrame,
    key: list[str],
    longest: int | None = None,
    threshold: float = SECOND_THRESHOLD,
) -> DataFrame:
    """Per unit the names found, as spans: ``key`` columns and ``spans``.

    ``gazetteer`` has form (words in lower case, one space between), ty, score.
    A small list is broadcast; a large one is joined by shuffle, where adaptive
    execution splits the sequences that are most frequent. Names are as long as
    the longest of the list, unless ``longest`` sets a number of words.
    """
    best = F.min(F.struct((-F.col("score")).alias("minus"), "ty")).alias("b")
    forms = (
        gazetteer.where(F.col("score") >= threshold)
        .groupBy("form")
        .agg(best)
        .select("form", "b.ty", (-F.col("b.minus")).cast("double").alias("score"))
    )
    if longest is None:
        longest = forms.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1
    if small_enough(forms):
        forms = F.broadcast(forms)
    cut = spread(units.select(*key, "text")).select(*key, F.explode(F.expr(_sequences("text", longest))).alias("s"))
    return _per_unit(cut.select(*key, "s.*").join(forms, "form"), key)


def _per_unit(hits: DataFrame, key: list[str]) -> DataFrame:
    """Collect the names of each text; their value is cut from it on use."""
    return hits.groupBy(*key).agg(
        F.collect_list(
            F.struct("st", "ln", F.lit(900).alias("pr"), "ty", "score", F.lit("").alias("v"))
        ).alias("spans")
    )


def model_spans(
    units: DataFrame,
    find: Callable[[Iterator], Iterator],
    key: list[str],
    key_schema: str,
) -> DataFrame:
    """Spans from a recogniser of the user's own.

    ``find`` maps an iterator of pandas batches (key columns, text) to batches of
    (key columns, st, ln, ty, score); it can load its model once per task.
    """
    rows = units.select(*key, "text").mapInPandas(
        find, f"{key_schema}, st int, ln int, ty string, score double"
    )
    return _per_unit(rows, key)
