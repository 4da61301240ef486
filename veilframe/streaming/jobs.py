"""The same operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators import detect as D
from veilframe.operators.restoring import restore_tokens
from veilframe.plans.jobs import audit, mask
from veilframe.sources.sessions import new_sessions
from veilframe.sources.sinks import write_batch


def hits(
    stream: DataFrame, keep: list[str], text: str = "text", lang: str = "auto"
) -> DataFrame:
    """Stateless detection: the batch expression, unchanged, one row per span."""
    return D.found_in(stream, keep, text, lang)


def hits_per_window(
    stream: DataFrame, at: str, width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Hits per time window and type, out of the rows of ``hits``."""
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, width), "ty")
        .agg(F.count(F.lit(1)).alias("hits"))
        .select(F.col("window.start").alias("start"), "ty", "hits")
    )


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, taking what there is now."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def in_batches(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batch_table(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """What earlier batches wrote; a repeated batch does not see its own rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not spark.read.parquet(path).columns:
        return None
    return spark.read.parquet(path).where(F.col("batch_id") < before)


def _replace_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's rows as its own partition, so a repeat replaces them."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def mask_batches(
    out: str,
    text: str = "text",
    seq: str = "doc_seq",
    group: str = "group_id",
    at: str | None = None,
    ttl: str | None = None,
    sessions: str | None = None,
    audits: str | None = None,
    secret: str | None = None,
    **options,
) -> Callable[[DataFrame, int], None]:
    """What is done with each batch of a stream to mask it.

    The state is the entity table ``out``/entities: each batch looks its values
    up there and appends what is new. It is joined and numbered like any table,
    so one busy group does not sit in a single task. A repeated batch replaces all it
    wrote: masked texts, entities, and its folders below ``sessions`` and ``audits``, which
    read_batches() reads. With ``at`` and ``ttl`` (such as ``24 hours``) a group's values are forgotten
    once they are that much older than the batch.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        existing = _batch_table(spark, f"{out}/entities", batch_id)
        if existing is not None and at is not None and ttl is not None:
            newest = batch.agg(F.max(at)).first()[0]
            if newest is not None:
                existing = existing.where(F.col("seen_at") >= F.lit(newest) - F.expr(f"interval {ttl}"))
        result = mask(
            batch, text, seq, group, existing=None if existing is None else existing.drop("batch_id", "seen_at"),
            secret=secret, **options,
        )
        _replace_batch(result.masked, f"{out}/masked", batch_id)
        fresh = result.entities
        if existing is not None:
            fresh = fresh.join(existing.select("group_id", "norm"), ["group_id", "norm"], "left_anti")
        if at is not None:
            seen = batch.select(
                F.col(group).cast("string").alias("group_id"), F.col(seq).cast("bigint").alias("doc_seq"),
                F.col(at).alias("seen_at"),
            )
            fresh = fresh.join(seen, ["group_id", "doc_seq"], "left")
        _replace_batch(fresh, f"{out}/entities", batch_id)
        if sessions is not None:
            rows = new_sessions(
                result.used, ["group_id", "doc_seq"], secret, group_id=F.col("group_id"),
                session_id=F.sha2(F.concat_ws(":", "group_id", "doc_seq"), 256),
            )
            write_batch(rows, sessions, str(batch_id))
        if audits is not None:
            users = result.masked.withColumn("user_token", F.col("group_id"))
            write_batch(audit(users, result.used, ["group_id", "doc_seq", "unit_no"]), audits, str(batch_id), "json")

    return work


def masked_stream(stream: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Mask a stream with tokens that stay the same from batch to batch; see mask_batches()."""
    return in_batches(stream, mask_batches(out, **options), checkpoint)


def late_to_quarantine(
    stream: DataFrame, at: str, delay: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Split messages by a watermark kept over batches: on time, and too late.

    The watermark is the newest time of earlier batches minus ``delay``. Late
    rows are kept in a table of their own and not dropped.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = _batch_table(spark, f"{out}/marks", batch_id)
        newest = None if marks is None else marks.agg(F.max("newest")).first()[0]
        late = F.lit(False)
        if newest is not None:
            late = F.coalesce(F.col(at) < F.lit(newest) - F.expr(f"interval {delay}"), F.lit(False))
        _replace_batch(batch.where(~late), f"{out}/on_time", batch_id)
        _replace_batch(batch.where(late), f"{out}/late", batch_id)
        _replace_batch(batch.agg(F.max(at).alias("newest")), f"{out}/marks", batch_id)

    return in_batches(stream, work, checkpoint)


def restored_stream(
    stream: DataFrame, token_map: DataFrame, out: str, checkpoint: str, scope: str = "group_id",
    text: str = "text", key: tuple[str, ...] = ("doc_seq",),
) -> StreamingQuery:
    """Restore tags in a stream of replies against a static token map.

    Tags are pulled out row by row and joined to the map; each batch is put
    together again by its own keys.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        back = restore_tokens(batch, text, token_map, [scope], list(key), "restored_text")
        _replace_batch(back, out, batch_id)

    return in_batches(stream, work, checkpoint)
