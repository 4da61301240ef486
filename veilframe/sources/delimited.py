"""Delimited files as rows of cells, however wide a row and however large a file.

Spark's text source deals a file out in splits of whole lines. Whether a line begins
inside a quoted cell depends on all lines before it in the file, but each split either
turns that state into a fixed one, keeps it or swaps it. So a first pass over the lines with quotes
tells what every split does, a window over the splits of a file tells in which state
each begins, and a second pass cuts the lines into rows. A row that lies in several splits is put
together from their pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.shared import staged

QUOTE = '"'
# May stand before the first character of a file.
MARK = "\ufeff"
# As many splits as begin inside a cell are told to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
# Pieces of a row in the order in which they stand in a split.
HEAD, THROUGH, TAIL = 0, 1, 2


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Is the end of a line inside a quoted cell? A quote within plain text is a character."""
    at = 0
    while True:
        if not inside and line.startswith(QUOTE, at):
            inside, at = True, at + 1
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def cells_of(row: str, sep: str) -> list[str]:
    """The cells of one row; a cell whose quote is never closed ends with the row."""
    if QUOTE not in row:
        return row.split(sep)
    cells, at = [], 0
    while True:
        cell = ""
        if row.startswith(QUOTE, at):
            at += 1
            while True:
                end = row.find(QUOTE, at)
                if end < 0:
                    end = len(row)
                cell += row[at:end]
                at = end + 1
                if not row.startswith(QUOTE, at):
                    break
                cell += QUOTE
                at += 1
        end = row.find(sep, at)
        cells.append(cell + (row[at:] if end < 0 else row[at:end]))
        if end < 0:
            return cells
        at = end + len(sep)


def rows_of(text: str, sep: str) -> list[list[str]]:
    """All rows of a text that is at hand."""
    rows, open_lines, inside = [], [], False
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    for line in lines:
        open_lines.append(line)
        inside = ends_inside(line, inside, sep)
        if not inside:
            rows.append(cells_of("\n".join(open_lines).removesuffix("\r"), sep))
            open_lines = []
    return rows + [cells_of("\n".join(open_lines), sep)] * bool(open_lines)


def line_of(cells: Column, sep: str = ",") -> Column:
    """One row as text; cells that need it are quoted."""
    special = f"[{sep}\"\\n\\r]"

    def quoted(cell: Column) -> Column:
        doubled = F.concat(F.lit(QUOTE), F.replace(cell, F.lit(QUOTE), F.lit(QUOTE * 2)), F.lit(QUOTE))
        return F.when(cell.rlike(special), doubled).otherwise(cell)

    return F.array_join(F.transform(cells, quoted), sep)


def _text(line: bytes) -> str:
    """Bytes that are no UTF-8 are left out."""
    return (line or b"").decode("utf-8", "ignore")


# --- first pass: what a split does to the state ----------------------------------------

STATES = "path string, start long, from_out boolean, from_in boolean"


def _states(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        key, states = None, [False, True]

        def row():
            return pa.RecordBatch.from_pylist(
                [{"path": key[0], "start": key[1], "from_out": states[0], "from_in": states[1]}],
                pa.schema([("path", pa.string()), ("start", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())]),
            )

        for batch in batches:
            for path, start, line in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "line")), strict=True):
                if (path, start) != key:
                    if key:
                        yield row()
                    key, states = (path, start), [False, True]
                text = _text(line).removeprefix(MARK if start == 0 else "")
                states = [ends_inside(text, s, sep) for s in states]
        if key:
            yield row()

    return run


def _open_splits(lines: DataFrame, sep: str) -> DataFrame:
    """path, start, inside: the splits that begin or end inside a cell."""
    quoted = lines.where(F.contains("line", F.lit(QUOTE).cast("binary")))
    does = quoted.mapInArrow(_states(sep), STATES)
    every = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("lines"))
    every = every.join(does, ["path", "start"], "left").select(
        "path", "start", F.coalesce("from_out", F.lit(False)).alias("a"), F.coalesce("from_in", F.lit(True)).alias("b")
    )
    by = Window.partitionBy("path").orderBy("start")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum((F.col("a") & ~F.col("b")).cast("long")).over(upto)
    every = every.withColumn("swaps", swaps)
    # The state after a split: that of the last fixed one, swapped as often as was since.
    fixed = F.last(F.when(F.col("a") == F.col("b"), F.struct("a", "swaps")), ignorenulls=True).over(upto)
    every = every.withColumn("fixed", fixed)
    odd = (F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    every = every.withColumn("after", F.coalesce("fixed.a", F.lit(False)) != odd)
    before = F.coalesce(F.lag("after").over(by), F.lit(False))
    return every.select("path", "start", before.alias("inside"), "after").where(F.col("inside") | F.col("after"))


# --- second pass: lines to rows --------------------------------------------------------

ROWS = "path string, position long, cells array<string>, piece int, text string"
_ROWS = pa.schema(
    [
        ("path", pa.string()),
        ("position", pa.int64()),
        ("cells", pa.list_(pa.string())),
        ("piece", pa.int32()),
        ("text", pa.string()),
    ]
)


def _rows(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows and pieces of rows. A row stands at its split's start plus the number of its line there."""

    def run(batches):
        key, first, lines, inside, n, begun = None, 0, [], False, 0, False

        def left():
            """What is open where the split ends."""
            if not lines:
                return []
            piece = TAIL if begun else THROUGH
            return [{"path": key[0], "position": first, "piece": piece, "text": "\n".join(lines)}]

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("path", "start", "line", "inside"))
            for path, start, raw, entered in zip(*columns, strict=True):
                if (path, start) != key:
                    out += left()
                    key, lines, inside, n, begun = (path, start), [], entered, 0, not entered
                    first = start
                line = _text(raw)
                if start == 0 and n == 0:
                    line = line.removeprefix(MARK)
                if not lines:
                    first = start + n
                n += 1
                lines.append(line)
                if inside or QUOTE in line:
                    inside = ends_inside(line, inside, sep)
                    if inside:
                        continue
                text = "\n".join(lines).removesuffix("\r")
                row = {"path": path, "position": first}
                out.append(row | ({"cells": cells_of(text, sep)} if begun else {"piece": HEAD, "text": text}))
                lines, begun = [], True
            if out:
                yield pa.RecordBatch.from_pylist(out, _ROWS)
        if rest := left():
            yield pa.RecordBatch.from_pylist(rest, _ROWS)

    return run


def _cells(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            cells = [cells_of(t, sep) for t in batch.column("text").to_pylist()]
            columns = [batch.column("path"), batch.column("position"), pa.array(cells, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "position", "cells"])

    return run


def read_rows(spark: SparkSession, path: str, wanted: Column, sep: str) -> DataFrame:
    """path, position, cells of the files below ``path`` for which ``wanted`` holds.

    ``wanted`` is a test of the column ``path``. Rows keep their blank cells and may differ
    in length; a blank line is a row with one blank cell. Rows end with a line feed, a
    carriage return before it is left out. ``position`` rises along a file.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    ).where(wanted)
    entered = staged(_open_splits(lines, sep), "splits").select("path", "start", "inside")
    n = entered.limit(BROADCAST_ROWS + 1).count()
    if n == 0:
        whole = lines.withColumn("inside", F.lit(False)).mapInArrow(_rows(sep), ROWS)
        return whole.select("path", "position", "cells")
    if n <= BROADCAST_ROWS:
        entered = F.broadcast(entered)
        told = lines.join(entered, ["path", "start"], "left")
    else:
        numbered = lines.withColumn("n", F.monotonically_increasing_id())
        told = numbered.join(entered, ["path", "start"], "left").sortWithinPartitions("path", "start", "n").drop("n")
    # Pieces come from the open splits alone; a row begins with a tail and goes on up to a head.
    open_lines = told.where(F.col("inside").isNotNull()).mapInArrow(_rows(sep), ROWS).where("piece IS NOT NULL")
    order = Window.partitionBy("path").orderBy("position", "piece").rowsBetween(Window.unboundedPreceding, 0)
    chained = open_lines.withColumn("row", F.sum((F.col("piece") == TAIL).cast("long")).over(order))
    in_order = F.array_sort(F.collect_list(F.struct("position", "piece", "text")))
    joined = chained.groupBy("path", "row").agg(
        F.min("position").alias("position"), F.array_join(F.transform(in_order, lambda p: p.text), "\n").alias("text")
    )
    broken = joined.mapInArrow(_cells(sep), "path string, position long, cells array<string>")
    cut = told.withColumn("inside", F.coalesce("inside", F.lit(False))).mapInArrow(_rows(sep), ROWS)
    return cut.where("piece IS NULL").select("path", "position", "cells").unionByName(broken)
