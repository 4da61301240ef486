"""The session table: which text or file was masked when, and its token map.

Parquet, partitioned by day: session_id, group_id, user_token, filename,
entity_map_enc, entities_count, lang, created_at, created_date. A session holds
the tokens of its own text or file; a group's map is the union of its sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.crypto import decrypt_map, encrypt_map
from veilframe.functions.text import identifier_list
from veilframe.operators.entities import last_written
from veilframe.shared import staged

SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("user_token", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("entity_map_enc", T.BinaryType()),
        T.StructField("entities_count", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("created_date", T.DateType()),
    ]
)
TTL_HOURS = 24


def new_sessions(
    used: DataFrame,
    by: list[str],
    secret: str,
    session_id: Column | None = None,
    group_id: Column | None = None,
    user_token: Column | None = None,
    filename: Column | None = None,
    lang: Column | None = None,
    created_at: Column | None = None,
) -> DataFrame:
    """Session rows out of (``by``, token, original), one per text or file."""
    rows = used.groupBy(*by).agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("token", "original")))).alias("m")
    )
    at = F.current_timestamp() if created_at is None else created_at
    default = F.lit
    return rows.select(
        (F.uuid() if session_id is None else session_id).alias("session_id"),
        (default(None).cast("string") if group_id is None else group_id).alias("group_id"),
        (default("default") if user_token is None else user_token).alias("user_token"),
        (default("text_input") if filename is None else filename).alias("filename"),
        encrypt_map(F.col("m"), secret).alias("entity_map_enc"),
        F.size("m").alias("entities_count"),
        (default("auto") if lang is None else lang).alias("lang"),
        at.alias("created_at"),
        F.to_date(at).alias("created_date"),
    )


def append_sessions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("created_date").parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The table; files written before a column was added read as null there."""
    return spark.read.schema(SCHEMA).option("mergeSchema", "true").parquet(path)


def live(table: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Sessions within their time to live; whole days and years before it are not read."""
    limit = now - F.make_dt_interval(hours=F.lit(ttl_hours))
    # A table may be partitioned by days or by anything up to a year that holds them.
    return table.where((F.col("created_at") >= limit) & (F.col("created_date") >= F.trunc(F.to_date(limit), "year")))


def expire(spark: SparkSession, path: str, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Drop old sessions from the table: whole days go, the oldest day is rewritten."""
    limit = now - F.make_dt_interval(hours=F.lit(ttl_hours))
    edge = spark.range(1).select(F.date_format(F.to_date(limit), "yyyy-MM-dd")).first()[0]
    table = read_sessions(spark, path)
    # Written aside first: a partition cannot be read while it is replaced.
    kept = staged(live(table, now, ttl_hours).where(F.col("created_date") == F.lit(edge)), "kept")
    nothing_kept = kept.isEmpty()
    if not nothing_kept:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "created_date"
        ).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        day = name.removeprefix("created_date=")
        if day != name and (day < edge or (day == edge and nothing_kept)):
            fs.delete(status.getPath(), True)
    return read_sessions(spark, path)


def sessions(table: DataFrame, user_token: str | None = None) -> DataFrame:
    """The listing, newest first; the token map stays out of it."""
    if user_token is not None:
        table = table.where(F.col("user_token") == user_token)
    return table.select(
        "session_id", "group_id", "filename", "created_at", "entities_count"
    ).orderBy(F.desc("created_at"), "session_id")


def tokens_of(table: DataFrame, secret: str) -> DataFrame:
    """Token maps as rows: session_id, group_id, created_at, token, original."""
    return table.select(
        "session_id",
        "group_id",
        "created_at",
        F.explode(decrypt_map(F.col("entity_map_enc"), secret)).alias("token", "original"),
    )


def group_map(tokens: DataFrame) -> DataFrame:
    """One map per group, merged over its sessions in order of creation."""
    return last_written(
        tokens.where(F.col("group_id").isNotNull()), ["group_id"], ["created_at", "session_id"]
    )


def identifiers(requests: DataFrame, ids: str) -> DataFrame:
    """The single identifiers of each distinct list, with their position."""
    return (
        requests.select(F.col(ids).alias("ids"))
        .distinct()
        .select("ids", F.posexplode(identifier_list(F.col("ids"))).alias("at", "id"))
    )


def resolve(requests: DataFrame, ids: str, table: DataFrame) -> DataFrame:
    """Sessions behind each identifier list: ids, at, id, session_id.

    An identifier is taken as a session first and as a group only if there is no
    such session. One that is neither comes with a null session.
    """
    wanted = identifiers(requests, ids)
    known = table.select("session_id", "group_id")
    as_session = wanted.join(
        known.select(F.col("session_id").alias("id"), "session_id"), "id"
    ).select("ids", "at", "id", "session_id")
    rest = wanted.join(as_session.select("id").distinct(), "id", "left_anti")
    as_group = rest.join(
        known.where(F.col("group_id").isNotNull()).select(
            F.col("group_id").alias("id"), "session_id"
        ),
        "id",
        "left",
    ).select("ids", "at", "id", "session_id")
    return as_session.unionByName(as_group)


def resolve_status(requests: DataFrame, ids: str, table: DataFrame) -> DataFrame:
    """Per list whether anything was found: 200, or 404 if nothing was."""
    found = resolve(requests, ids, table).groupBy("ids").agg(
        F.count("session_id").alias("sessions")
    )
    every = requests.select(F.col(ids).alias("ids")).distinct()
    return every.join(found, "ids", "left").select(
        "ids",
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.when(F.coalesce("sessions", F.lit(0)) > 0, 200).otherwise(404).alias("status"),
    )


def resolved_map(requests: DataFrame, ids: str, table: DataFrame, secret: str) -> DataFrame:
    """The merged map of each identifier list: ids, token, original.

    Only the maps of sessions that a list asks for are decrypted, each of them once.
    """
    hits = resolve(requests, ids, table).where(F.col("session_id").isNotNull())
    asked = table.join(hits.select("session_id").distinct(), "session_id", "left_semi")
    tokens = tokens_of(asked, secret).drop("group_id")
    return last_written(
        hits.join(tokens, "session_id"), ["ids"], ["at", "created_at", "session_id"]
    )
