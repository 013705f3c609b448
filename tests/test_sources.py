import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import office
from quire.streaming import watch


def package(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries:
            z.writestr(name, text)
    return out.getvalue()


XLSX = package([
    ("xl/workbook.xml", '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="예산" r:id="r1"/></sheets></workbook>'),
    ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/></Relationships>'),
    ("xl/sharedStrings.xml", "<sst><si><t>항목</t><rPh><t>x</t></rPh></si><si><r><t>금</t></r><r><t>액</t></r></si></sst>"),
    ("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;d&quot;mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'),
    ("xl/worksheets/one.xml", '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>132.30000000000001</v></c><c s="1"><v>45306</v></c><c t="b"><v>1</v></c></row>'
     '<row><c t="inlineStr"><is><t>in</t></is></c><c><f>A1+1</f></c></row></sheetData><mergeCells><mergeCell ref="A2:A2"/></mergeCells></worksheet>'),
])
DOCX = package([
    ("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p>'
     '<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
     '<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'),
    ("word/styles.xml", '<w:styles xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'),
])
SECTION = '<s><p><run><t>머리말</t></run></p><p><run><tbl><tr><tc><cellAddr colAddr="0" rowAddr="0"/><cellSpan colSpan="2" rowSpan="1"/><subList><p><run><t>칸</t></run></p></subList></tc></tr></tbl></run></p></s>'
HWPX = package([
    ("mimetype", "application/hwp+zip"), ("version.xml", "<v/>"), ("META-INF/container.xml", "<c/>"), ("Contents/content.hpf", '<p><item href="section0.xml"/></p>'),
    ("Contents/header.xml", '<h secCnt="1"/>'), ("Contents/section0.xml", SECTION),
])
HWPML = "﻿<?xml version='1.0'?><HWPML><BODY><SECTION><P><TEXT><CHAR>본문</CHAR></TEXT></P></SECTION></BODY></HWPML>".encode()


def compound(streams):
    """A compound file whose streams are 4,096 bytes or more: header, directory, allocation table, then the data."""
    sectors, entries, table = [], [], []
    entries.append(("Root Entry", 5, 0xFFFFFFFE, 0))
    at = 2
    for name, data in streams:
        data = data.ljust(4096, b"\0")
        n = -(-len(data) // 512)
        entries.append((name, 2, at, len(data)))
        sectors += [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        table += [*range(at + 1, at + n), 0xFFFFFFFE]
        at += n
    directory = b"".join((n.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", len(n) * 2 + 2, k, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, size) for n, k, first, size in entries)
    fat = struct.pack("<II", 0xFFFFFFFE, 0xFFFFFFFD) + struct.pack(f"<{len(table)}I", *table)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, 0, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 1, *[0xFFFFFFFF] * 108)
    return head.ljust(512, b"\0") + directory.ljust(512, b"\0") + fat.ljust(512, b"\xff") + b"".join(sectors)


def biff(*recs):
    return b"".join(struct.pack("<HH", k, len(b)) + b for k, b in recs)


def workbook():
    strings = struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 1) + "항목".encode("utf-16-le") + struct.pack("<HB", 5, 0) + b"pla"
    heads = lambda at: [(0x809, struct.pack("<HH", 0x600, 5)), (0xE0, struct.pack("<HH", 0, 0)), (0xE0, struct.pack("<HH", 0, 14)), (0x85, struct.pack("<IBB", at, 0, 0) + bytes([1, 0]) + b"S"),
                        (0xFC, strings), (0x3C, b"\0in"), (0x0A, b"")]
    sheet = biff((0x809, struct.pack("<HH", 0x600, 16)), (0xFD, struct.pack("<HHHI", 1, 0, 0, 0)), (0xFD, struct.pack("<HHHI", 1, 1, 0, 1)), (0x27E, struct.pack("<HHHI", 2, 0, 0, (1234 << 2) | 3)),
                 (0x203, struct.pack("<HHHd", 2, 1, 1, 45306.0)), (0xBD, struct.pack("<HHHIHIH", 3, 0, 0, (5 << 2) | 2, 0, ((-7 & 0x3FFFFFFF) << 2) | 2, 1)), (0x205, struct.pack("<HHHBB", 4, 0, 0, 1, 0)),
                 (0x205, struct.pack("<HHHBB", 4, 1, 0, 7, 1)), (0xE5, struct.pack("<HHHHH", 1, 1, 1, 0, 1)), (0x0A, b""))
    return biff(*heads(len(biff(*heads(0))))) + sheet


def test_xls():
    data = compound([("Workbook", workbook())])
    got = office.decode(data, "hwp")
    assert got["format"] == "xls" and got["error"] is None, got
    texts = {(c["r"], c["c"]): c["text"] for c in got["cells"]}
    assert texts == {(0, 0): "항목", (1, 0): "12.34", (1, 1): "2024-01-15", (2, 0): "5", (2, 1): "-7", (3, 0): "TRUE", (3, 1): "#DIV/0!"}
    assert got["cells"][0]["col_span"] == 2
    assert office.decode(compound([("FileHeader", b"x")]), "hwp")["error"] == "UNSUPPORTED_FORMAT"
    rng = random.Random(3)
    for _ in range(60):
        bad = bytearray(data)
        for _ in range(6):
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        assert set(office.decode(bytes(bad[: rng.randrange(8, len(bad))]), "hwp")) == set(got)


def test_xlsx():
    got = office.decode(XLSX, "hwpx")
    assert got["format"] == "xlsx" and got["error"] is None
    assert [(b["type"], b["text"], b["page_number"]) for b in got["blocks"]] == [("heading", "예산", 1), ("table", None, 1)]
    texts = {(c["r"], c["c"]): c["text"] for c in got["cells"]}
    assert texts == {(0, 0): "항목", (0, 1): "금액", (0, 2): "", (1, 0): "132.3", (1, 1): "2024-01-15", (1, 2): "TRUE", (2, 0): "in", (2, 1): "=A1+1", (2, 2): ""}


def test_docx():
    got = office.decode(DOCX, "hwpx")
    assert [(b["type"], b["text"], b["level"]) for b in got["blocks"]] == [("heading", "Title", 1), ("paragraph", "Text", None), ("table", None, None)]
    assert [(c["r"], c["c"], c["text"], c["row_span"]) for c in got["cells"]] == [(0, 0, "a", 2), (0, 1, "b", 1), (1, 1, "c", 1)]


def test_hwpx_and_validator():
    got = office.decode(HWPX, "hwpx")
    assert [b["type"] for b in got["blocks"]] == ["paragraph", "table"] and got["cells"][0]["col_span"] == 2
    assert office.validate_hwpx(HWPX) == []
    assert {x["code"] for x in office.validate_hwpx(package([("a.txt", "")]))} == {"MIMETYPE_FIRST", "MIMETYPE_CONTENT", "MISSING"}
    broken = HWPX[: HWPX.rindex(b"PK\x01\x02")]
    assert [b["text"] for b in office.decode(broken, "hwpx")["blocks"]][:1] == ["머리말"]


@pytest.mark.parametrize("content", [XLSX, DOCX, HWPX, HWPML])
def test_damage_gives_codes(content):
    rng = random.Random(7)
    cases = [content[: len(content) // 2], content[: len(content) * 9 // 10], b"", None]
    for _ in range(30):
        data = bytearray(content)
        for _ in range(8):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        cases.append(bytes(data))
    for data in cases:
        got = office.decode(data, "hwpml" if content is HWPML else "hwpx")
        assert set(got) == {"format", "blocks", "cells", "title", "error"}


def test_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.xlsx", XLSX), ("b.docx", DOCX), ("c.hwpx", HWPX), ("d.hml", HWPML), ("e.pdf", b"%PDF-1.4 x"), ("f.txt", b"x")):
        (folder / name).write_bytes(data)
    parsed = office.parse_files(spark.read.format("binaryFile").load(str(folder)))
    rows = {r.path.rsplit("/", 1)[1]: (r.format, r.error) for r in parsed.collect()}
    assert rows["d.hml"] == ("hwpml", None) and rows["e.pdf"] == ("pdf", "UNSUPPORTED_FORMAT") and rows["f.txt"] == ("unknown", "UNSUPPORTED_FORMAT")
    assert office.file_cells(parsed).count() == 9 + 3 + 1
    query = watch.run(watch.watch(spark, str(folder)), str(tmp_path / "state"), watch.to_parquet(str(tmp_path / "out")), once=True)
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.where(F.col("error").isNull()).count() == 4
