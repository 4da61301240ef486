"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.shared import CHECKPOINT_DIR, fresh_path, staged, staged_at  # noqa: F401


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_path(spark, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def running_total(
    df: DataFrame, keys: list[str], block: str, order: list[str | Column], value: Column, name: str
) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before this one, within ``keys``.

    ``block`` is a number that rises with ``order``. Rows are summed inside a
    block and blocks inside a key, so that no task holds a whole key.
    """
    at, own = f"{name}_base", f"{name}_own"
    by = [*keys, block]
    sums = df.groupBy(*by).agg(F.sum(value).alias(own))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, F.coalesce(F.sum(own).over(before), F.lit(0)).alias(at))
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn(own, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    renamed = bases.select(*[F.col(c).alias(f"{name}_{c}") for c in by], at)
    same = [F.col(c).eqNullSafe(F.col(f"{name}_{c}")) for c in by]
    return (
        inside.join(renamed, same)
        .withColumn(name, F.col(at) + F.col(own))
        .drop(at, own, *[f"{name}_{c}" for c in by])
    )


def hex_digest(items: Column) -> Column:
    """SHA-256 of strings joined by commas, in lower-case hex."""
    return F.sha2(F.concat_ws(",", items), 256)
