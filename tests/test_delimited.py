"""Delimited files cut into many splits against Python's own reader."""

import csv
import io
import random

import pytest

from veilframe.sources import delimited, readers


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, so that rows and cells lie over them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def table(dice, sep, lines):
    """Rows with quotes, line feeds, blank cells at the end and other scripts."""
    parts = ["", "a", "b c", '"', '""', sep, "\n", "\r\n", "é", "日本", "x" * 40, "5\" pipe", " ", "\n\n\n"]
    out = []
    for i in range(lines):
        width = dice.choice([1, 2, 3, 300 if i % 40 == 7 else 4])
        out.append([f"{i}", *("".join(dice.choice(parts) for _ in range(dice.randint(0, 3))) for _ in range(width))])
    return out


def plain(path, sep):
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.reader(f, delimiter=sep))


@pytest.mark.parametrize(("kind", "sep"), [("csv", ","), ("tsv", "\t")])
def test_rows_over_splits(small_splits, tmp_path, kind, sep):
    spark, dice = small_splits, random.Random(3)
    want = {}
    for name, lines in (("a", 400), ("b", 150), ("c", 1)):
        file = tmp_path / f"{name}.{kind if name != 'b' else kind.upper()}"
        with open(file, "w", encoding="utf-8", newline="") as f:
            csv.writer(f, delimiter=sep, lineterminator="\r\n" if name == "b" else "\n").writerows(table(dice, sep, lines))
        want[file.name] = plain(file, sep)
    (tmp_path / f"long.{kind}").write_text(('1,"' + "line\n" * 2_000 + '",end\n2,x,\n').replace(",", sep), encoding="utf-8")
    want[f"long.{kind}"] = plain(tmp_path / f"long.{kind}", sep)
    rows = readers.read_cells(spark, str(tmp_path), sep)
    assert rows.rdd.getNumPartitions() > 20
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.path, r.position)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.cells)
    assert got == want
    again = io.StringIO()
    lines = rows.select(delimited.line_of(rows.cells, sep).alias("line")).collect()
    again.write("\n".join(r.line for r in lines))
    again.seek(0)
    assert sorted(csv.reader(again, delimiter=sep)) == sorted(r for rows in want.values() for r in rows)


def test_many_open_splits_without_a_broadcast(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "BROADCAST_ROWS", 3)
    text = "".join(f'{i},"{"line " * 30}\nmore",\n' for i in range(300))
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    rows = readers.read_cells(small_splits, str(tmp_path)).collect()
    assert [r.cells for r in sorted(rows, key=lambda r: r.position)] == plain(tmp_path / "a.csv", ",")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a,b\n", [["a", "b"]]),
        ("a,,\n,\n", [["a", "", ""], ["", ""]]),
        ('x,"never closed\nto the end', [["x", "never closed\nto the end"]]),
        ('say "hi", you\n"q""q"z,1\r\n', [['say "hi"', " you"], ['q"qz', "1"]]),
        ("﻿k,v\n\n1,2", [["k", "v"], [""], ["1", "2"]]),
        ("", []),
    ],
)
def test_odd_rows(spark, tmp_path, text, want):
    (tmp_path / "a.csv").write_bytes(text.encode())
    rows = readers.read_cells(spark, str(tmp_path)).collect()
    assert [r.cells for r in sorted(rows, key=lambda r: r.position)] == want
    assert delimited.rows_of(text.removeprefix("﻿"), ",") == want


def test_bytes_that_are_no_text_are_left_out(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"a\xffb\tc\xc3\n")
    assert [r.cells for r in readers.read_cells(spark, str(tmp_path), "\t").collect()] == [["ab", "c"]]
