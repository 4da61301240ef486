"""Give every entity a stand-in that is unique in its group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import fakes
from veilframe.functions.text import norm
from veilframe.shared import staged


def faked(numbered: DataFrame, secret: str, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``token``: equal to no original and no other token of the group.

    An entity takes the stand-in of its ordinal. If that is an original or an earlier token of
    the group, or belongs to an entity of another type, the entity takes an ordinal after the highest
    one of its type, until it has a stand-in of its own. Few do, so later turns are small. Only where a type has
    no more stand-ins an entity gets a bracketed token that no generator makes.
    """
    key = F.expr(norm("token"))
    closed = numbered.select("group_id", F.col("norm").alias("key"))
    if existing is not None:
        closed = closed.unionByName(existing.select("group_id", F.col("norm").alias("key"))).unionByName(
            existing.select("group_id", key.alias("key"))
        )
    top = numbered.groupBy("group_id", "ty").agg(F.max("n").alias("top"))
    left = numbered.select("group_id", "norm", "ty", "n", "original")
    chosen: DataFrame | None = None
    while True:
        tried = fakes.stand_ins(left, secret).where("token IS NOT NULL").withColumn("key", key)
        tried = staged(tried, "stand-ins")
        free = tried.join(closed, ["group_id", "key"], "left_anti")
        if chosen is not None:
            free = free.join(chosen, ["group_id", "key"], "left_anti")
        owners = free.groupBy("group_id", "key").agg(F.min(F.struct("n", "ty", "norm", "token")).alias("o"))
        won = staged(owners.select("group_id", "key", "o.norm", "o.token"), "owners")
        chosen = won if chosen is None else chosen.unionByName(won)
        lost = tried.join(won.select("group_id", "norm"), ["group_id", "norm"], "left_anti")
        if lost.isEmpty():
            break
        turn = Window.partitionBy("group_id", "ty").orderBy("n")
        moved = lost.withColumn("at", F.row_number().over(turn)).join(top, ["group_id", "ty"])
        left = staged(moved.select("group_id", "norm", "ty", (F.col("top") + F.col("at")).alias("n"), "original"), "moved")
        top = top.join(left.groupBy("group_id", "ty").agg(F.max("n").alias("new")), ["group_id", "ty"], "left").select(
            "group_id", "ty", F.coalesce("new", "top").alias("top")
        )
    return numbered.join(chosen.select("group_id", "norm", "token"), ["group_id", "norm"], "left").withColumn(
        "token", F.coalesce("token", F.expr(fakes.fallback()))
    )
