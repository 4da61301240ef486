"""Files as rows of strings: which reader serves which file ending."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import html
from veilframe.shared import staged
from veilframe.sources import leaves
from veilframe.sources.containers import PLAIN, text_units
from veilframe.sources.delimited import line_of, read_rows, rows_of

# --- Fixed values: file endings by kind ----------------------------------------
KINDS = {
    "text": ("txt", "md", "markdown", "rtf"),
    "csv": ("csv",),
    "tsv": ("tsv",),
    "json": ("json",),
    "xml": ("xml", "mxl"),
    "html": ("html", "htm"),
    "container": ("docx", "xlsx", "pptx", "pptm", "odt", "ods", "odp", "vsdx", "zip", "pbix"),
    # Known, but read by tools for single files that are not part of this package.
    "not_built": ("xls", "ppt", "pdf", "png", "jpg", "jpeg", "bmp", "gif"),
}
# -----------------------------------------------------------------------------


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./\\]+)$", 1)


def kind_of(path: Column) -> Column:
    """The kind of a file by its ending; ``unknown`` goes to quarantine."""
    found = F.lit(None).cast("string")
    for kind, endings in KINDS.items():
        found = F.when(extension(path).isin(*endings), kind).otherwise(found)
    return F.coalesce(found, F.lit("unknown"))


def decoded(path: Column) -> Column:
    """A path of which some signs are written as their numbers, as Spark gives and names folders."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def name_of(path: Column) -> Column:
    """The name of the file that a path stands for: its own, or that of a file written in parts."""
    plain = decoded(path)
    written = F.regexp_extract(plain, r"/filename=([^/]+)/[^/]+$", 1)
    return F.when(written != "", decoded(written)).otherwise(F.element_at(F.split(plain, "/"), -1))


def is_kind(kind: str, path: Column | None = None) -> Column:
    """Does a path name a file of a kind? On Spark's metadata column this prunes the listing."""
    return kind_of(name_of(F.col("path") if path is None else path)) == kind


def read_whole(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Whole files of one kind: path, content."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = files.where(is_kind(kind, F.col("_metadata.file_path")))
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


SEPARATORS = {"csv": ",", "tsv": "\t"}


def read_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited files as rows of cells, header row included: path, position, cells.

    Rows may differ in length and be of any; cells may hold line feeds. See read_rows().
    """
    kind = next((k for k, s in SEPARATORS.items() if s == sep), "csv")
    return read_rows(spark, path, is_kind(kind), sep)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _rows_of(text: pd.Series, sep: pd.Series) -> pd.Series:
    return pd.Series([rows_of(t, s) for t, s in zip(text, sep, strict=True)], dtype="object")


def _opened(plain: DataFrame, masked: bool) -> DataFrame:
    """Rows of plain files and members (path, member, kind, content): one per line of a
    delimited one, one for any other."""
    content = F.col("content")
    none = F.lit(None).cast("string")
    whole = plain.where(~F.col("kind").isin(*SEPARATORS)).select(
        "path", "member", "kind", F.lit(0).cast("long").alias("position"), "content",
        _leaves(F.col("kind"), content, masked).alias("leaves"),
    )
    sep = F.when(F.col("kind") == "tsv", SEPARATORS["tsv"]).otherwise(SEPARATORS["csv"])
    lines = plain.where(F.col("kind").isin(*SEPARATORS)).select(
        "path", "member", "kind", F.posexplode(_rows_of(content, sep)).alias("position", "leaves")
    )
    return whole.unionByName(
        lines.select("path", "member", "kind", F.col("position").cast("long").alias("position"), none.alias("content"), "leaves")
    )


def _leaves(kind: Column, content: Column, masked: bool) -> Column:
    """The strings to mask in a file that is read whole; null if it is malformed."""
    parts = html.text_parts(content)
    return (
        F.when(kind == "text", F.array(content))
        .when(kind == "html", F.transform(parts, html.shown) if masked else parts)
        .when(kind == "json", leaves.json_strings(F.when(kind == "json", content)))
        .when(kind == "xml", leaves.xml_strings(F.when(kind == "xml", content)))
    )


def read_members(containers: DataFrame, masked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Archives and office documents (path, content): rows with their strings, and what was not read.

    A member of an archive is read by its own format; nested archives are entered.
    """
    none = F.lit(None).cast("string")
    packed = staged(text_units(containers), "members")
    inner = packed.where(F.col("kind") != "error")
    plain = inner.where(F.col("kind").isin(*PLAIN)).select(
        "path", "member", kind_of(F.col("member")).alias("kind"), F.col("text").alias("content")
    )
    office = (
        inner.where(~F.col("kind").isin(*PLAIN))
        .groupBy("path", "member", "kind")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "text"))), lambda s: s.text).alias("leaves"))
        .select("path", "member", "kind", F.lit(0).cast("long").alias("position"), none.alias("content"), "leaves")
    )
    unread = packed.where(F.col("kind") == "error").select("path", "member", F.col("text").alias("reason"))
    return _opened(plain, masked).unionByName(office), unread


def read_documents(spark: SparkSession, path: str, masked: bool = False) -> tuple[DataFrame, DataFrame]:
    """All files below ``path``: rows with their strings, and what was not read.

    Rows: path, member, kind, position, content, leaves. A delimited file or member of an
    archive gives one row per line, any other one row; an office document, whose kind is
    its ending, one row with its text units. Endings count in any letter case. ``masked``
    reads what mask_files() wrote: tokens in markup are markup there.
    """
    none = F.lit(None).cast("string")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = F.col("_metadata.file_path")
    # Only the bytes of containers are read; the listing itself takes paths alone.
    containers = listing.where(is_kind("container", at)).select(at.alias("path"), "content")
    rows, unread = read_members(containers, masked)
    for kind in ("text", "json", "xml", "html"):
        files = read_whole(spark, path, kind).select(
            "path", name_of(F.col("path")).alias("member"), F.lit(kind).alias("kind"), "content"
        )
        strings = _leaves(F.col("kind"), F.col("content"), masked)
        rows = rows.unionByName(
            files.select("path", "member", "kind", F.lit(0).cast("long").alias("position"), "content", strings.alias("leaves"))
        )
    for kind, sep in SEPARATORS.items():
        rows = rows.unionByName(
            read_cells(spark, path, sep).select(
                "path", name_of(F.col("path")).alias("member"), F.lit(kind).alias("kind"), "position",
                none.alias("content"), F.col("cells").alias("leaves"),
            )
        )
    broken = rows.where(F.col("leaves").isNull()).select(
        "path", "member", F.concat(F.lit("malformed "), "kind").alias("reason")
    )
    rows = rows.where(F.col("leaves").isNotNull())
    unknown = (
        listing.select(at.alias("path"), name_of(at).alias("member"))
        .select("path", "member", kind_of(F.col("member")).alias("reason"))
        .where(F.col("reason").isin("unknown", "not_built"))
    )
    unread = unread.unionByName(unknown).unionByName(broken)
    return rows, unread


def rewritten(kind: Column, content: Column, strings: Column, changes: Column, masked: bool = False) -> Column:
    """The content of a row of read_documents() with changed strings: a line of a delimited
    file, the units of an office document line by line, else the whole file.

    ``masked`` says that the content was masked and its strings are being restored.
    """
    new = leaves.put_in(strings, changes)
    markup = F.when(kind == "html", content)
    done = html.html_restored(markup, changes, leaves.put_in) if masked else html.html_changed(markup, changes, leaves.put_in)
    found = (
        F.when(kind == "text", F.coalesce(F.element_at(changes, content), content))
        .when(kind == "html", done)
        .when(kind == "json", leaves.json_changed(F.when(kind == "json", content), changes))
        .when(kind == "xml", leaves.xml_changed(F.when(kind == "xml", content), changes))
    )
    for delimited, sep in SEPARATORS.items():
        found = found.when(kind == delimited, line_of(new, sep))
    return found.otherwise(F.array_join(new, "\n"))
