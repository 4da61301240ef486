"""WARC archives of pages: written with a gzip member per record, and read in sequence.

Of records with equal payloads of at least ``SMALLEST`` bytes the one with the largest
page_id is a response; the others are revisits, which name it and carry only the
HTTP header of the original. Archives lie in the shared folder. Each attempt of a
task writes files of its own names; only files of the attempts that succeeded are
in the manifest, which Spark commits, so a lost or repeated task leaves no trace.

The reader takes one record after the other: it inflates step by step, frames the
block by its Content-Length, and checks the block's and the payload's digest.

Edge cases: a null html is an empty payload; a null url leaves out the target; a
null page_id is written as ``null`` and is never referred to, unless it is all
there is: then each such record is a response; of repeated rows with the largest
page_id all are responses; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilframe.llm.common import fresh_path, staged

SMALLEST = 1000
# An archive is closed when it has grown to this many bytes.
ARCHIVE_BYTES = 32 << 20
# Payloads held by this share of all rows or more are told to every task: at most 256.
HEAVY_SHARE = 256
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"

READ = StructType(
    [
        StructField("page_id", LongType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("record_type", StringType()),
        StructField("refers_to", LongType()),
        StructField("target", StringType()),
    ]
)


class DigestError(ValueError):
    """A record's bytes are not those that its header names."""


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, and refers_to for pages that revisit another."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    light = staged(
        rows.where(F.octet_length("html") >= SMALLEST).groupBy("digest").agg(
            F.max("page_id").alias("first"), F.count("*").alias("n")
        ),
        "warc-digests",
    )
    total = light.agg(F.sum("n")).first()[0] or 0
    again = light.where("n > 1")
    heavy = again.where(F.col("n") * HEAVY_SHARE >= total).select(
        F.col("digest").alias("h"), F.col("first").alias("heavy")
    )
    other = again.where(F.col("n") * HEAVY_SHARE < total).select(F.col("digest").alias("d"), "first")
    # Rows of heavy payloads have their answer already; the hash of their row spreads them.
    key = F.when(F.col("h").isNull(), F.col("digest")).otherwise(
        F.concat(F.lit("h"), F.coalesce("page_id", F.monotonically_increasing_id()).cast("string"))
    )
    met = rows.join(F.broadcast(heavy), F.col("digest") == F.col("h"), "left").withColumn("key", key)
    met = met.join(other, F.col("key") == F.col("d"), "left").withColumn("to", F.coalesce("heavy", "first"))
    return met.select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("to")), F.col("to")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        # A line break would end the header.
        target = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {target}")
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: {name(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return packer.compress(text) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``planned`` pages below ``folder``; the manifest: path, records, bytes."""

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, at, done, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{at}"]), pa.array([done], pa.int64()), pa.array([size], pa.int64())],
                ["path", "records", "bytes"],
            )

        for batch in batches:
            for page_id, url, html, digest, to in zip(*[c for c in batch.columns], strict=True):
                if out is None:
                    at, done, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{at}", compression=None)
                member = record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), to.as_py())
                out.write(member)
                done, size = done + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(
        run, "path string, records long, bytes long"
    )


class Inflated:
    """Bytes of a file of gzip members, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.raw, self.ready = stream, b"", b""
        self.member = None

    def more(self) -> bool:
        """Inflate one more piece; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw and self.member is None:
                return False
        ended = not self.raw
        self.member = self.member or zlib.decompressobj(31)
        piece = self.member.decompress(self.raw, CHUNK)
        if self.member.eof:
            self.raw, self.member = self.member.unused_data, None
        else:
            self.raw = self.member.unconsumed_tail
            if ended and not piece:
                raise DigestError("the archive ends within a record")
        self.ready += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``; None if nothing is left."""
        while mark not in self.ready:
            if not self.more():
                if self.ready:
                    raise DigestError("the archive ends within a header")
                return None
        found, _, self.ready = self.ready.partition(mark)
        return found

    def pieces(self, n: int):
        """The next n bytes, piece by piece."""
        while n:
            if not self.ready and not self.more():
                raise DigestError("the archive ends within a block")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(stream, keep_payload: bool = False):
    """Each record of an archive as (header, http header, payload bytes, payload digest, payload)."""
    source = Inflated(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        block, payload = hashlib.sha1(), hashlib.sha1()
        http, size, kept = None, 0, []
        for piece in source.pieces(int(fields["content-length"])):
            block.update(piece)
            if not isinstance(http, dict):
                http = (http or b"") + piece
                if b"\r\n\r\n" not in http:
                    continue
                text, _, piece = http.partition(b"\r\n\r\n")
                http = _fields(text)
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        if source.until(b"\r\n\r\n") != b"":
            raise DigestError("a record does not end where its length says")
        digest = payload.hexdigest()
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "revisit":
            # The payload is that of the record it refers to.
            size, digest = int(http["content-length"]), stated
        if digest != stated or block.hexdigest() != fields["warc-block-digest"].removeprefix("sha1:"):
            raise DigestError(f"wrong digest in {fields['warc-record-id']}")
        yield fields, http, size, digest, b"".join(kept)


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that ``manifest`` names."""

    def number(name: str | None):
        text = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "null") else None

    def run(batches):
        from pyarrow import fs

        def emit(rows):
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], READ.names
            )

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                rows = []
                with files.open_input_stream(at, compression=None) as stream:
                    for fields, _, size, digest, _ in records(stream):
                        rows.append(
                            (
                                number(fields["warc-record-id"]), size, digest, fields["warc-type"],
                                number(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
                            )
                        )
                        if len(rows) == 4096:
                            yield emit(rows)
                            rows = []
                if rows:
                    yield emit(rows)

    return manifest.select("path").repartition("path").mapInArrow(run, READ)


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Pages written as archives in the shared folder and read back from them."""
    folder = fresh_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = f"file://{folder}"
    manifest = staged(write(planned(pages, **names), folder), "warc-manifest")
    return read(manifest)
