"""Run queries and their oracle side by side: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark, con, sf: str, name: str) -> tuple[str, int]:
    """An empty string where both sides agree, else what is wrong; and the row count."""
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "", len(rows)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", len(rows)
    ours, theirs = canonical(df.columns, rows), canonical(columns, expected)
    if ours != theirs:
        extra = sorted(set(ours) - set(theirs))[:2]
        missing = sorted(set(theirs) - set(ours))[:2]
        return f"rows {len(ours)} / {len(theirs)}; extra {extra}; missing {missing}", len(rows)
    return "", len(rows)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = session(), oracle_connection(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            wrong, n = difference(spark, con, sf, name)
        except Exception as problem:  # the report goes on with the next query
            wrong, n = f"{type(problem).__name__}: {str(problem)[:600]}", -1
        bad += bool(wrong)
        checked = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{name:32s} {n:8d} {time.time() - start:6.1f}s {wrong or 'ok'}{checked}", flush=True)
    print(f"{len(names)} queries, {bad} wrong")


if __name__ == "__main__":
    main()
