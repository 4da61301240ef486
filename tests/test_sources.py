import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.plans import files
from veilframe.sources import containers, leaves, readers
from veilframe.sources.containers import text_units

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return buffer.getvalue()


def docx():
    body = f"<w:document {W}><w:p><w:r><w:t>Тел </w:t></w:r><w:r><w:t>+7 999 123-45-67</w:t></w:r></w:p></w:document>"
    head = f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>"
    return packed(**{"word/document.xml": body, "word/header1.xml": head})


def test_containers(spark):
    xlsx = packed(**{
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si><si><t>CONFIDENTIAL</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><c t="s"><v>1</v></c><c t="n"><v>5</v></c><c t="s"><v>0</v></c></worksheet>',
    })
    pptx = packed(**{"ppt/slides/slide1.xml": f"<p {A}><a:r><a:t>slide</a:t></a:r></p>"})
    odt = packed(**{"content.xml": "<a>one<b>two</b>three</a>"})
    archive = packed(**{"in/a.docx": docx(), "b.zip": packed(**{"c.txt": "deep"}), "d.exe": b"x", "e.docx": b"bad"})
    rows = [("f/a.docx", docx()), ("f/b.xlsx", xlsx), ("f/c.pptx", pptx), ("f/d.odt", odt), ("f/e.zip", archive)]
    got = text_units(spark.createDataFrame(rows, "path string, content binary")).collect()
    texts = {}
    for r in sorted(got, key=lambda r: (r.path, r.unit_no)):
        texts.setdefault((r.path, r.kind), []).append(r.text)
    assert texts["f/a.docx", "docx"] == ["Тел +7 999 123-45-67", "head"]
    assert texts["f/b.xlsx", "xlsx"] == ["CONFIDENTIAL", "Name"]
    assert texts["f/c.pptx", "pptx"] == ["slide"]
    assert texts["f/d.odt", "odt"] == ["one", "two", "three"]
    assert texts["f/e.zip", "txt"] == ["deep"]
    assert len(texts["f/e.zip", "error"]) == 2


def test_a_member_that_cannot_be_read_stops_no_other():
    raw = bytearray(packed(**{"a.txt": "locked", "b.txt": "open"}))
    # The sign of an encrypted member, in its own header and in the directory.
    raw[raw.index(b"PK\x03\x04") + 6] |= 1
    raw[raw.index(b"PK\x01\x02") + 8] |= 1
    found = list(containers._units("z.zip", bytes(raw)))
    assert [(m, k) for m, k, _ in found] == [("z.zip/a.txt", "error"), ("z.zip/b.txt", "txt")]


def test_cells_of_formulas_and_cells_without_value():
    sheet = f'<worksheet {S}><c t="str"><v>joined</v></c><c t="s"/><c t="str"/></worksheet>'
    found = list(containers._units("s.xlsx", packed(**{"xl/worksheets/sheet1.xml": sheet})))
    assert found == [("s.xlsx", "xlsx", "joined")]


def test_endings_in_any_letter_case(spark, tmp_path):
    (tmp_path / "A.TXT").write_text("a")
    (tmp_path / "C.Csv").write_text("1,2\n")
    (tmp_path / "D.DOCX").write_bytes(docx())
    (tmp_path / "E.EXE").write_text("?")
    rows, unread = readers.read_documents(spark, str(tmp_path))
    assert {r.member: r.leaves for r in rows.collect()} == {
        "A.TXT": ["a"], "C.Csv": ["1", "2"], "D.DOCX": ["Тел +7 999 123-45-67", "head"]
    }
    assert [(r.member, r.reason) for r in unread.collect()] == [("E.EXE", "unknown")]


SECRET = "Клиент, тел +7 999 123-45-67"
FILES = {
    "a.txt": f"{SECRET}\nmore\n",
    "b.json": json.dumps([{"n": SECRET, "x": 1}, "ok"], ensure_ascii=False),
    "d.html": f"<html><p title='{SECRET}'>{SECRET} &lt;PHONE_RU_1&gt; and &#060;PHONE_RU_1&gt;</p>\n<b>&amp;</b></html>",
    "e.csv": f'имя,тел,\nАнна,"{SECRET}",\n"say ""hi""",,,\n',
    "sub dir/e.csv": f'"{SECRET}"\n',
    "f+g%20.TSV": f"k\t{SECRET}\t\n",
}


def test_what_was_masked_comes_back(spark, tmp_path):
    """Files of every format, and as members of an archive, through masked files and back."""
    for name, content in FILES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(content)
    inner = packed(**{"deep.csv": FILES["e.csv"]})
    members = {name.replace("sub dir/", "sub/"): content for name, content in FILES.items()}
    (tmp_path / "in" / "z.zip").write_bytes(packed(**members, **{"in.zip": inner}))
    done = files.mask_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), group_id="p", lang="ru")
    files.write_files(done.files, str(tmp_path / "masked"))
    # Only the attribute keeps its number: HTML is masked between its tags.
    for part in (tmp_path / "masked").rglob("part-*"):
        text = part.read_text().replace(f"title='{SECRET}'", "")
        assert "+7 999" not in text and "PHONE_RU_1" in text
    back = files.restore_files(spark, str(tmp_path / "masked"), str(tmp_path / "back"), done.result.token_map, "p")
    assert back.unread.count() == 0
    got = {}
    for r in sorted(back.files.collect(), key=lambda r: (r.path, r.position)):
        # One folder per source file tells those of one name apart.
        got.setdefault((r.filename, r.path.split("source=")[1][:16]), []).append(r.content.removesuffix("\n"))
    got = sorted((name, "\n".join(rows)) for (name, _), rows in got.items())
    want = [(name.removeprefix("sub dir/"), content) for name, content in FILES.items()]
    want += [(f"z.zip/{name}", content) for name, content in members.items()]
    want += [("z.zip/in.zip/deep.csv", FILES["e.csv"])]
    assert got == sorted((name, content.removesuffix("\n")) for name, content in want)


def test_files_come_back_by_identifiers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f'1,"{SECRET}"\n')
    out = str(tmp_path / "out")
    done = files.mask_files(spark, str(tmp_path / "in"), out, lang="ru", sessions=f"{out}/sessions", secret="s")
    files.write_files(done.files, f"{out}/masked")
    table = readers_of_sessions(spark, f"{out}/sessions")
    session = table.first()
    assert (session.filename, session.entities_count) == ("a.csv", 1)
    back = files.restore_files_by_ids(spark, f"{out}/masked", f"{out}/back", session.session_id, table, "s")
    assert [r.units for r in back.files.collect()] == [["1", SECRET]]
    with pytest.raises(LookupError):
        files.restore_files_by_ids(spark, f"{out}/masked", f"{out}/back", "unknown", table, "s")


def readers_of_sessions(spark, path):
    from veilframe.sources.sessions import read_sessions

    return read_sessions(spark, path)


def test_folder_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    secret = "Клиент, тел +7 999 123-45-67"
    (source / "a.txt").write_text(secret)
    (source / "b.json").write_text(json.dumps([{"n": secret, "x": 1}, "ok"], ensure_ascii=False))
    (source / "c.xml").write_text(f'<r at="{secret}"><p>{secret}</p>tail</r>')
    (source / "d.html").write_text(f"<html><p>{secret}</p></html>")
    (source / "e.csv").write_text(f'имя,тел\nАнна,"{secret}"\n')
    (source / "f.docx").write_bytes(docx())
    (source / "g.pdf").write_bytes(b"%PDF")
    (source / "h.json").write_text("{broken")
    done = files.mask_files(spark, str(source), str(tmp_path / "out"), group_id="p", lang="ru")
    rows = {r.member: r for r in done.files.collect() if r.kind != "csv"}
    for member in ("a.txt", "b.json", "c.xml", "d.html"):
        assert "+7 999" not in rows[member].content and "<PHONE_RU_1>" in rows[member].content.replace("&lt;", "<").replace("&gt;", ">")
    assert rows["a.txt"].filename == "safe_a.txt"
    assert "Тел <PHONE_RU_1>" in rows["f.docx"].units
    cells = [r.units for r in done.files.where("kind = 'csv'").collect()]
    assert ["имя", "тел"] in cells and any("<PHONE_RU_1>" in c[1] for c in cells)
    assert {r.member for r in done.unread.collect()} == {"g.pdf", "h.json"}
    back = tmp_path / "masked"
    back.mkdir()
    for member in ("a.txt", "b.json"):
        (back / f"safe_{member}").write_text(rows[member].content)
    again = files.restore_files(spark, str(back), str(tmp_path / "back"), done.result.token_map, "p")
    restored = {r.filename: r.content for r in again.files.collect()}
    assert restored["a.txt"] == secret
    assert json.loads(restored["b.json"]) == [{"n": secret, "x": 1}, "ok"]


def test_nested_columns(spark):
    df = spark.createDataFrame(
        [(1, {"a": [{"b": "x", "n": 1}], "m": {"k": "x", "l": None}})],
        "k int, doc struct<a:array<struct<b:string,n:int>>,m:map<string,string>>",
    )
    assert df.select(leaves.row_strings(df, ["doc"])).first()[0] == ["x", "x"]
    changed = leaves.apply_changes(df.withColumn("changes", F.create_map(F.lit("x"), F.lit("y"))), ["doc"])
    row = changed.first().doc
    assert row.a[0].b == "y" and row.a[0].n == 1 and row.m == {"k": "y", "l": None}
