"""Mask and restore whole folders of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import masked_name, restored_name
from veilframe.plans.jobs import MaskResult, mask_rows, restore_rows
from veilframe.shared import staged
from veilframe.sources import leaves
from veilframe.sources import sessions as Sess
from veilframe.sources.containers import OFFICE
from veilframe.sources.readers import name_of, read_documents, rewritten
from veilframe.sources.sinks import write_files, write_masked  # noqa: F401


@dataclass(frozen=True)
class FileResult:
    """``files`` as written, ``unread`` with the reason, and the mask result."""

    files: DataFrame
    unread: DataFrame
    result: MaskResult | None


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in the order they are read; fixed by writing them down at once."""
    return staged(rows.withColumn("doc_seq", F.monotonically_increasing_id()), "documents")


def _written(rows: DataFrame, out: str, named, unread: DataFrame, masked: bool) -> DataFrame:
    kept = leaves.put_in(F.col("leaves"), F.col("changes"))
    name = named(F.col("member"))
    # What cannot be written in its own format is written as lines of text.
    name = F.when(F.col("kind").isin(*OFFICE), F.concat(name, F.lit(".txt"))).otherwise(name)
    done = rows.select(
        "group_id",
        "path",
        "member",
        "kind",
        "doc_seq",
        "position",
        name.alias("filename"),
        kept.alias("units"),
        rewritten(F.col("kind"), F.col("content"), F.col("leaves"), F.col("changes"), masked).alias("content"),
    )
    spark = rows.sparkSession
    write_masked(done, f"{out}/files")
    unread.write.mode("append").parquet(f"{out}/unread")
    return spark.read.schema(done.schema).parquet(f"{out}/files")


def mask_files(
    spark: SparkSession, path: str, out: str, group_id: str | None = None, sessions: str | None = None, **options
) -> FileResult:
    """Mask all files below ``path`` into ``out``; one group, or one per file.

    ``out/files`` is a table of rows with their masked ``content``; write_files() makes
    files of it again, which restore_files() reads. ``out/unread`` tells what was not read.
    ``sessions`` is the session table to which every file with identifiers is added,
    encrypted with ``secret``; its session has the tokens that the file uses.
    """
    if sessions is not None and not options.get("secret"):
        raise ValueError("sessions need a secret")
    rows, unread = read_documents(spark, path)
    scope = F.lit(group_id) if group_id else F.sha2("path", 256)
    rows = _numbered(rows.withColumn("group_id", scope))
    masked, result = mask_rows(rows, F.col("leaves"), "doc_seq", "group_id", **options)
    if sessions is not None:
        where = rows.select("group_id", "doc_seq", "path")
        used = result.used.join(where, ["group_id", "doc_seq"])
        made = Sess.new_sessions(
            used.select("group_id", "path", "token", "original").distinct(), ["group_id", "path"], options["secret"],
            session_id=F.sha2(F.concat_ws("\n", F.lit(out), "path"), 256),
            group_id=F.lit(group_id).cast("string"), filename=name_of(F.col("path")),
        )
        Sess.append_sessions(made, sessions)
    return FileResult(_written(masked, out, masked_name, unread, False), unread, result)


def restore_files(
    spark: SparkSession, path: str, out: str, token_map: DataFrame, group_id: str
) -> FileResult:
    """Restore all masked files below ``path`` with the token map of a group."""
    rows, unread = read_documents(spark, path, masked=True)
    rows = _numbered(rows.withColumn("group_id", F.lit(group_id)))
    back = restore_rows(rows, F.col("leaves"), "doc_seq", token_map, "group_id")
    return FileResult(_written(back, out, restored_name, unread, True), unread, None)


def restore_files_by_ids(
    spark: SparkSession, path: str, out: str, ids: str, table: DataFrame, secret: str,
    ttl_hours: int | None = Sess.TTL_HOURS,
) -> FileResult:
    """Restore all masked files below ``path`` with the maps of a list of sessions or groups."""
    if ttl_hours is not None:
        table = Sess.live(table, F.current_timestamp(), ttl_hours)
    asked = spark.createDataFrame([(ids,)], "ids string")
    if Sess.resolve_status(asked, "ids", table).first()["status"] != 200:
        raise LookupError(f"no session or group of {ids} is known")
    known = staged(Sess.resolved_map(asked, "ids", table, secret), "maps")
    return restore_files(spark, path, out, known.select(F.lit("ids").alias("group_id"), "token", "original"), "ids")
