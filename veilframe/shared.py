"""Where intermediate and output tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local master may go without the setting: there one folder of its
    own is made per session and remembered in the session's settings.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("veilframe.local.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="veilframe-")
    spark.conf.set("veilframe.local.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new sub-folder name under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Spark's own setting: the shuffle files of an execution are deleted when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_at(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), tidy: bool = False) -> DataFrame:
    """Write ``df`` once to ``path`` and read it back; see staged()."""
    spark = df.sparkSession
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(TIDY)
        elif tidy:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def staged(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), tidy: bool = False) -> DataFrame:
    """Write ``df`` once and read it back, so later steps do not recompute it.

    A written table survives the loss of any executor, is pruned by column and
    by partition when it is read, and gives every reader the same rows. ``tidy`` frees the
    disk that the shuffles of the work took: nothing but the written table is read later.
    """
    return staged_at(df, fresh_path(df.sparkSession, label), partition_by, tidy)


# An input is dealt out in tasks of this many bytes before costly work on it, one that is larger than
# the limit is not: moving it would cost more disk than its own splits cost balance.
SPREAD_BYTES = 4 * 1024 * 1024
SPREAD_LIMIT = 4 * 1024**3


def spread(df: DataFrame) -> DataFrame:
    """Give every core its share of an input before its texts are searched.

    Searching a text costs far more than moving it, and a file of a few row groups, or a join of
    small columns, gives a few tasks only. So all inputs are dealt out, those of unknown size and the
    batches of a stream too, but for those above SPREAD_LIMIT.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df.repartition(cores)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1)))
    if SPREAD_LIMIT < size < unknown:
        return df
    return df.repartition(max(cores, size // SPREAD_BYTES if size < unknown else 4 * cores))
