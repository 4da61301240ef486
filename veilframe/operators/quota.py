"""Usage limits per user and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.entities import with_running_total


def with_quota(
    usage: DataFrame, user: str, at: str, amount: Column, limit: float, tie: str
) -> DataFrame:
    """Adds period, used (so far in the month, this row included) and blocked.

    A user with very many rows is summed up block by block of time.
    """
    # About a millisecond; a block of the running total is then about a minute.
    timed = usage.withColumn("period", F.date_format(F.col(at).cast("timestamp"), "yyyy-MM")).withColumn(
        "_tick", F.shiftright(F.unix_micros(F.col(at).cast("timestamp")), 10)
    )
    summed = with_running_total(timed, [user, "period"], "_tick", [at, tie], amount, "used")
    return summed.drop("_tick").withColumn("blocked", F.col("used") > limit)
