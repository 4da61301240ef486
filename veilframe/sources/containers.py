"""Zip-based documents as text units: archives, OOXML, OpenDocument.

One row per unit (path, member, unit_no, kind, text), read file by file inside
the tasks of a ``binaryFile`` scan. What cannot be read becomes a row of kind
``error`` with the reason as its text; it does not stop its archive.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Characters and units of small files that are given out together.
GIVEN_OUT, GIVEN_OUT_ROWS = 4_000_000, 10_000
SCHEMA = "path string, member string, unit_no int, kind string, text string"

# --- Fixed values: file endings and XML names of the formats -------------------
ARCHIVES = ("zip", "pbix")
OPEN_DOCUMENT = ("odt", "ods", "odp", "vsdx")
PLAIN = ("txt", "md", "markdown", "rtf", "csv", "tsv", "json", "xml", "mxl", "html", "htm")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# -----------------------------------------------------------------------------


def _ending(name: str) -> str:
    return posixpath.splitext(name.lower())[1].lstrip(".")


def _numbered(name: str) -> tuple:
    """Sort slide10 after slide9."""
    return tuple(int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name))


def _texts(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _word(archive: zipfile.ZipFile) -> Iterator[str]:
    names = archive.namelist()
    parts = ["word/document.xml"]
    parts += sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
    for part in parts:
        # Paragraphs of table cells are paragraphs too.
        for paragraph in ElementTree.fromstring(archive.read(part)).iter(f"{W}p"):
            yield _texts(paragraph, f"{W}t")


def _slides(archive: zipfile.ZipFile) -> Iterator[str]:
    for pattern in (r"ppt/slides/slide\d+\.xml", r"ppt/notesSlides/notesSlide\d+\.xml"):
        for part in sorted((n for n in archive.namelist() if re.fullmatch(pattern, n)), key=_numbered):
            for run in ElementTree.fromstring(archive.read(part)).iter(f"{A}r"):
                yield _texts(run, f"{A}t")


def _sheets(archive: zipfile.ZipFile) -> Iterator[str]:
    names = archive.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
        shared = [_texts(item, f"{S}t") for item in root.iter(f"{S}si")]
    pages = (n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    for part in sorted(pages, key=_numbered):
        for cell in ElementTree.fromstring(archive.read(part)).iter(f"{S}c"):
            value = cell.findtext(f"{S}v") or ""
            if cell.get("t") == "s" and value:
                yield shared[int(value)]
            elif cell.get("t") == "str":
                # What a formula gave.
                yield value
            elif cell.get("t") == "inlineStr":
                yield _texts(cell, f"{S}t")


def _open_document(archive: zipfile.ZipFile) -> Iterator[str]:
    for part in ("content.xml", "styles.xml"):
        if part in archive.namelist():
            for node in ElementTree.fromstring(archive.read(part)).iter():
                yield node.text or ""
                yield node.tail or ""


_READERS = {"docx": _word, "pptx": _slides, "pptm": _slides, "xlsx": _sheets}
_READERS.update(dict.fromkeys(OPEN_DOCUMENT, _open_document))
# Kinds whose text is taken out in units.
OFFICE = tuple(_READERS)


def _units(name: str, content: bytes) -> Iterator[tuple[str, str, str]]:
    """(member, kind, text) of one file; archives are entered."""
    kind = _ending(name)
    try:
        if kind in ARCHIVES:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for item in archive.infolist():
                    if not item.is_dir():
                        yield from _member_units(name, archive, item)
        elif kind in _READERS:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                found = list(_READERS[kind](archive))
            for text in found:
                if text.strip():
                    yield name, kind, text
        elif kind in PLAIN:
            yield name, kind, content.decode("utf-8", errors="ignore")
        else:
            yield name, "error", f"format {kind} is not supported"
    except Exception as problem:  # noqa: BLE001 - a file that fails in any way is set aside, the others go on
        yield name, "error", f"{type(problem).__name__}: {problem}"


def _member_units(name: str, archive: zipfile.ZipFile, item: zipfile.ZipInfo) -> Iterator[tuple[str, str, str]]:
    """The units of one member; an encrypted or damaged one stops no other."""
    try:
        content = archive.read(item)
    except Exception as problem:  # noqa: BLE001
        yield posixpath.join(name, item.filename), "error", f"{type(problem).__name__}: {problem}"
        return
    for member, kind, text in _units(item.filename, content):
        yield posixpath.join(name, member), kind, text


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "member", "unit_no", "kind", "text"]
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for path, content in zip(batch["path"], batch["content"]):
            name = posixpath.basename(path)
            for i, (member, kind, text) in enumerate(_units(name, bytes(content))):
                rows.append((path, member, i, kind, text))
                size += len(text)
            # Small files share a table; the units of a large one are given out at once.
            if size > GIVEN_OUT or len(rows) > GIVEN_OUT_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def text_units(files: DataFrame) -> DataFrame:
    """Text units of ``files`` (path, content), the columns of ``binaryFile``."""
    return files.select("path", "content").mapInPandas(_read, SCHEMA)
