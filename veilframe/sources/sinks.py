"""Output tables: masked texts, audit events, and entities encrypted at rest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilframe.functions.crypto import key_of


def write_masked(df: DataFrame, path: str, order: tuple[str, ...] = ("group_id", "doc_seq")) -> None:
    """Append masked texts, sorted by group.

    Rows are dealt out by ranges of ``order``, so a busy group fills several files and small
    ones share one; a reader of one group is led to its files by their statistics.
    """
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(path)


def write_files(rows: DataFrame, path: str) -> None:
    """Write ``content`` of the rows of each file as text, below a folder that names the file.

    ``rows`` has path, filename, position and content. A file is one folder,
    ``source=<digest of its path>/filename=<name>``, and a large one has several parts in
    the order of its rows. Every row ends with a line feed.
    """
    source = F.substring(F.sha2("path", 256), 1, 16)
    named = rows.withColumn("source", source).select("source", "filename", "position", "content")
    order = ["source", "filename", "position"]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order)
    # A content that ends with a line feed has the one that the writer would add.
    text = F.regexp_replace("content", r"\n\z", "").alias("content")
    ranged.select("source", "filename", text).write.mode("append").partitionBy("source", "filename").text(path)


def append_audit(events: DataFrame, path: str) -> None:
    """One JSON object per line."""
    events.write.mode("append").json(path)


def write_batch(rows: DataFrame, path: str, batch: str, kind: str = "parquet") -> None:
    """Write the rows of one batch of a stream as a folder of its own.

    A batch that is repeated replaces what it wrote before; a batch that was not written to
    its end has no mark and is not read.
    """
    rows.write.mode("overwrite").format(kind).save(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """The rows of all batches that were written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = fs.listStatus(folder) if fs.exists(folder) else []
    mark = spark._jvm.org.apache.hadoop.fs.Path
    whole = [s.getPath().toString() for s in listed if fs.exists(mark(s.getPath(), "_SUCCESS"))]
    reader = spark.read.schema(schema).format(kind)
    return reader.load(whole) if whole else spark.createDataFrame([], schema)


def append_entities(entities: DataFrame, path: str, secret: str) -> None:
    """Add new entities of a run; originals are stored encrypted only."""
    sealed = F.aes_encrypt(F.col("original").cast("binary"), key_of(secret), F.lit("GCM"))
    hidden = F.aes_encrypt(F.col("norm").cast("binary"), key_of(secret), F.lit("GCM"))
    entities.select(
        "group_id", "ty", "token", sealed.alias("original_enc"), hidden.alias("norm_enc")
    ).write.mode("append").parquet(path)


def read_entities(spark: SparkSession, path: str, secret: str) -> DataFrame | None:
    """The entity table in clear, or None before the first run."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return None
    key = key_of(secret)

    def opened(column: str):
        return F.aes_decrypt(F.col(column), key, F.lit("GCM")).cast("string")

    return stored.select(
        "group_id", opened("norm_enc").alias("norm"), "ty", "token",
        opened("original_enc").alias("original"),
    )
