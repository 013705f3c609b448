"""Office files as blocks and cells: spreadsheets (xlsx, xls), word files (docx), hwpx packages and single-file hwpml. Standard library only.

Files of all kinds meet in one pass over binary rows; each file gives one row with its blocks and cells, or an error code, never an exception.
Blocks: (block_id, type, text, level, page_number); a table's cells: (block_id, r, c, text, col_span, row_span).
"""

from __future__ import annotations

import math
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import ole, xls

#: Limits that belong to the formats' handling (fixed values): bytes and entries of a package, rows, columns and sheets.
MOST_BYTES, MOST_ENTRIES, MOST_ROWS, MOST_COLS, MOST_SHEETS = 256 << 20, 500, 10_000, 200, 100
#: Built-in number formats that are dates, and those with a time (fixed values).
DATE_FORMATS, TIME_FORMATS = frozenset(range(14, 18)), frozenset([*range(18, 23), 45, 46, 47])

BLOCKS = "array<struct<block_id:int,type:string,text:string,level:int,page_number:int>>"
CELLS = "array<struct<block_id:int,r:int,c:int,text:string,col_span:int,row_span:int>>"
PARSED = f"format string, blocks {BLOCKS}, cells {CELLS}, title string, error string"


class DecodeError(Exception):
    """An error code and what happened."""


class _Out:
    """Blocks and cells in the making."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.cells: list[dict] = []
        self.title: str | None = None

    def block(self, kind: str, text: str | None, level: int | None = None, page: int | None = None) -> int:
        self.blocks.append({"block_id": len(self.blocks), "type": kind, "text": text, "level": level, "page_number": page})
        return len(self.blocks) - 1

    def table(self, cells: dict[tuple[int, int], tuple[str, int, int]], page: int | None = None) -> None:
        at = self.block("table", None, page=page)
        self.cells += [{"block_id": at, "r": r, "c": c, "text": t, "col_span": w, "row_span": h} for (r, c), (t, w, h) in sorted(cells.items())]


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _find(e: ElementTree.Element, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = next((x for x in e if _name(x) == name), None)
        if e is None:
            return None
    return e


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _name(x) == name)


def _xml(data: bytes) -> ElementTree.Element:
    text = data.decode("utf-8-sig", "replace")
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "", text, flags=re.I)
    try:
        return ElementTree.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text))
    except ElementTree.ParseError as e:
        raise DecodeError("PARSE_ERROR") from e


class _Package:
    """A zip file's entries, within the limits."""

    def __init__(self, content: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(BytesIO(content))
        except (zipfile.BadZipFile, NotImplementedError, ValueError, EOFError, OSError) as e:
            raise DecodeError("CORRUPTED") from e
        entries = self.zip.infolist()
        if len(entries) > MOST_ENTRIES or sum(x.file_size for x in entries) > MOST_BYTES:
            raise DecodeError("ZIP_BOMB")
        self.names = [x.filename for x in entries]

    def read(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError) as e:
            raise DecodeError("CORRUPTED") from e

    def xml(self, name: str) -> ElementTree.Element | None:
        data = self.read(name)
        return None if data is None else _xml(data)


def zip_format(content: bytes) -> str:
    """xlsx, docx, hwpx or unknown, by a package's entries."""
    try:
        names = _Package(content).names
    except DecodeError:  # a package without a readable directory may still show sections
        return "hwpx" if next(_salvaged(content), None) is not None else "unknown"
    if "xl/workbook.xml" in names:
        return "xlsx"
    if "word/document.xml" in names:
        return "docx"
    return "hwpx" if "mimetype" in names or any(n.startswith("Contents/") for n in names) else "unknown"


def clean_number(raw: str) -> str:
    """A decimal literal with 15 significant digits at most: without an exponent from 1e-6 on up to 1e21, and no sign before 0."""
    if not re.fullmatch(r"-?[0-9]+\.[0-9]+", raw) or math.isinf(float(raw)):
        return raw
    value = float(f"{float(raw):.15g}")
    if value == 0 or 1e-6 <= abs(value) < 1e21:
        plain = format(Decimal(repr(abs(value))), "f")
        return "-" * (value < 0) + (plain.rstrip("0").rstrip(".") if "." in plain else plain)
    digits, exponent = repr(value).split("e")
    return f"{digits.removesuffix('.0')}e{int(exponent):+d}"


def date_kind(code: str) -> str | None:
    """date, datetime or None for a number format's code."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    return None if not set(bare) & set("ymdh") else "datetime" if set(bare) & set("hs") else "date"


def serial_to_iso(serial: float, date1904: bool, kind: str) -> str | None:
    """A day number as ISO text; None when it is out of range."""
    days = serial + (1462 if date1904 else 1 if serial < 60 else 0)
    if serial < 0 or not days < 2_958_466:
        return None
    at = pd.Timestamp("1899-12-30") .to_pydatetime() + pd.Timedelta(milliseconds=int(days * 86_400_000 + 0.5)).to_pytimedelta()
    return at.strftime("%Y-%m-%dT%H:%M:%S" if kind == "datetime" else "%Y-%m-%d").zfill(10)


def _place(ref: str | None) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref or "")
    if not m:
        return None
    col = 0
    for ch in m[1]:
        col = 26 * col + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def _rich(e: ElementTree.Element) -> str:
    """Text of a shared or inline string, without its phonetic guides."""
    return "".join((x.text or "") if _name(x) == "t" else _rich(x) for x in e if _name(x) in ("t", "r"))


def _styles(root: ElementTree.Element | None) -> dict[int, str]:
    """Cell styles that show numbers as dates."""
    out: dict[int, str] = {}
    if root is None:
        return out
    codes = {int(_attr(x, "numFmtId") or 0): _attr(x, "formatCode") or "" for x in _all(root, "numFmt")}
    styles = _find(root, "cellXfs")
    for i, xf in enumerate(styles if styles is not None else ()):
        k = int(_attr(xf, "numFmtId") or 0)
        kind = "date" if k in DATE_FORMATS else "datetime" if k in TIME_FORMATS else date_kind(codes[k]) if k in codes else None
        if kind:
            out[i] = kind
    return out


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: dict[int, str], date1904: bool) -> str:
    kind, value, formula = _attr(cell, "t") or "n", _find(cell, "v"), _find(cell, "f")
    if kind == "inlineStr":
        inner = _find(cell, "is")
        return _rich(inner) if inner is not None else ""
    raw = (value.text or "") if value is not None else ""
    if not raw:
        return f"={formula.text}" if formula is not None and formula.text else ""
    if kind == "s":
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    style = _attr(cell, "s")
    if kind == "n" and style and style.isdigit() and int(style) in dates:
        try:
            return serial_to_iso(float(raw), date1904, dates[int(style)]) or raw
        except ValueError:
            return raw
    return clean_number(raw) if kind == "n" else raw


def decode_xlsx(content: bytes, out: _Out) -> None:
    """Each sheet as a heading and a table; a sheet's number is its page."""
    package = _Package(content)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise DecodeError("PARSE_ERROR")
    strings, styles = package.xml("xl/sharedStrings.xml"), package.xml("xl/styles.xml")
    shared = [_rich(x) for x in strings if _name(x) == "si"] if strings is not None else []
    dates = _styles(styles)
    props = _find(book, "workbookPr")
    date1904 = props is not None and _attr(props, "date1904") in ("1", "true")
    rels = package.xml("xl/_rels/workbook.xml.rels")
    targets = {_attr(x, "Id"): _attr(x, "Target") or "" for x in (rels if rels is not None else ())}
    for n, sheet in enumerate(list(_all(book, "sheet"))[:MOST_SHEETS], 1):
        target = targets.get(sheet.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"), f"worksheets/sheet{n}.xml")
        root = package.xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        out.block("heading", _attr(sheet, "name") or f"Sheet{n}", 2, n)
        if root is None:
            continue
        found: dict[tuple[int, int], str] = {}
        row_at = -1
        for row in _all(root, "row"):
            number = _attr(row, "r")
            row_at = int(number) - 1 if number and number.isdigit() else row_at + 1
            col_at = -1
            for cell in (x for x in row if _name(x) == "c"):
                place = _place(_attr(cell, "r"))
                col_at = place[1] if place else col_at + 1
                at = place or (row_at, col_at)
                if at[0] < MOST_ROWS and at[1] < MOST_COLS:
                    found[at] = _cell_text(cell, shared, dates, date1904)
        spans, hidden = {}, set()
        for merge in _all(root, "mergeCell"):
            first, _, last = (_attr(merge, "ref") or "").partition(":")
            a, b = _place(first), _place(last)
            if a and b and a[0] <= b[0] < MOST_ROWS and a[1] <= b[1] < MOST_COLS:
                spans[a] = (b[1] - a[1] + 1, b[0] - a[0] + 1)
                hidden |= {(r, c) for r in range(a[0], b[0] + 1) for c in range(a[1], b[1] + 1)} - {a}
        filled = [r for (r, c), t in found.items() if t.strip()]
        if filled:
            top, bottom = min(filled), max(filled)
            width = max(c for (r, c), t in found.items() if t.strip()) + 1
            out.table({(r - top, c): (found.get((r, c), ""), *spans.get((r, c), (1, 1))) for r in range(top, bottom + 1) for c in range(width) if (r, c) not in hidden}, n)


def _docx_text(p: ElementTree.Element) -> str:
    parts = []
    for x in p.iter():
        name = _name(x)
        if name == "t":
            parts.append(x.text or "")
        elif name in ("tab", "br", "cr") and name != _name(p):
            parts.append("\t" if name == "tab" else "\n")
    return "".join(parts)


def _docx_body(body: ElementTree.Element, levels: dict[str, int], out: _Out) -> None:
    for x in body:
        name = _name(x)
        if name == "sdt":
            inner = _find(x, "sdtContent")
            if inner is not None:
                _docx_body(inner, levels, out)
        elif name == "p":
            text = _docx_text(x).strip()
            style, numbering = _find(x, "pPr", "pStyle"), _find(x, "pPr", "numPr")
            level = levels.get(_attr(style, "val") or "") if style is not None else None
            if text:
                out.block("heading" if level else "list" if numbering is not None else "paragraph", text, level)
        elif name == "tbl":
            cells: dict[tuple[int, int], tuple[str, int, int]] = {}
            above: dict[int, tuple[int, int]] = {}
            for r, row in enumerate(y for y in x if _name(y) == "tr"):
                c = 0
                for cell in (y for y in row if _name(y) == "tc"):
                    span, merge = _find(cell, "tcPr", "gridSpan"), _find(cell, "tcPr", "vMerge")
                    width = int(_attr(span, "val") or 1) if span is not None else 1
                    if merge is not None and _attr(merge, "val") != "restart" and c in above:
                        t, w, h = cells[above[c]]
                        cells[above[c]] = (t, w, h + 1)
                    else:
                        cells[r, c] = ("\n".join(filter(None, (_docx_text(p).strip() for p in _all(cell, "p")))), width, 1)
                        above[c] = (r, c)
                        if merge is None:
                            above.pop(c)
                    c += width
            out.table(cells)


def decode_docx(content: bytes, out: _Out) -> None:
    """Paragraphs, headings by style, lists and tables with merged cells, in order."""
    package = _Package(content)
    root, styles = package.xml("word/document.xml"), package.xml("word/styles.xml")
    body = _find(root, "body") if root is not None else None
    if body is None:
        raise DecodeError("PARSE_ERROR")
    levels: dict[str, int] = {}
    for style in _all(styles, "style") if styles is not None else ():
        name = _find(style, "name")
        m = re.fullmatch(r"heading (\d)", (_attr(name, "val") or "").lower()) if name is not None else None
        outline = _find(style, "pPr", "outlineLvl")
        if m or (outline is not None and (_attr(outline, "val") or "9").isdigit() and int(_attr(outline, "val") or 9) < 6):
            levels[_attr(style, "styleId") or ""] = int(m[1]) if m else int(_attr(outline, "val") or 0) + 1
    core = package.xml("docProps/core.xml")
    title = next((x.text for x in core if _name(x) == "title"), None) if core is not None else None
    out.title = title
    _docx_body(body, levels, out)


def _hwpx_paragraph(p: ElementTree.Element, out: _Out) -> None:
    """A paragraph's text, then the tables that hang on it."""
    text = "".join("".join(t.itertext()) for run in p if _name(run) in ("run", "TEXT") for t in run if _name(t) in ("t", "CHAR")).strip()
    if text:
        out.block("paragraph", text)
    for run in (x for x in p if _name(x) in ("run", "TEXT")):
        for table in (x for x in run if _name(x) in ("tbl", "TABLE")):
            cells = {}
            for r, row in enumerate(y for y in table if _name(y) in ("tr", "ROW")):
                for c, cell in enumerate(y for y in row if _name(y) in ("tc", "CELL")):
                    at, span = _find(cell, "cellAddr"), _find(cell, "cellSpan")
                    get = lambda e, k, alt, cell=cell: int((_attr(e, k) if e is not None else _attr(cell, k[0].upper() + k[1:])) or alt)
                    lines = ["".join("".join(t.itertext()) for run in q for t in run if _name(t) in ("t", "CHAR")).strip() for q in cell.iter() if _name(q) in ("p", "P")]
                    place = get(at, "rowAddr", r), get(at, "colAddr", c)
                    cells[place] = ("\n".join(filter(None, lines)), get(span, "colSpan", 1), get(span, "rowSpan", 1))
            out.table(cells)


def decode_hwpx(content: bytes, out: _Out) -> None:
    """All sections, in order of their numbers; where the directory is damaged, what can be found."""
    try:
        package = _Package(content)
        names = sorted((n for n in package.names if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        if any("encryption-data" in (package.read(n) or b"").decode("utf-8", "replace") for n in package.names if n == "META-INF/manifest.xml"):
            raise DecodeError("ENCRYPTED")
        parts = [package.read(n) or b"" for n in names]
    except DecodeError as e:
        if str(e) != "CORRUPTED" or not (parts := list(_salvaged(content))):
            raise
    if not parts:
        raise DecodeError("NO_SECTIONS")
    for data in parts:
        for p in (x for x in _xml(data) if _name(x) == "p"):
            _hwpx_paragraph(p, out)


def _salvaged(content: bytes) -> Iterator[bytes]:
    """Sections by their local headers, for packages without a readable directory."""
    for m in re.finditer(rb"PK\x03\x04.{4}(?P<kind>..).{8}(?P<size>.{4}).{4}(?P<name>..)(?P<extra>..)", content, re.S):
        a = m.end() + int.from_bytes(m["name"], "little")
        if not re.fullmatch(rb"Contents/section\d+\.xml", content[m.end() : a]):
            continue
        a += int.from_bytes(m["extra"], "little")
        size = int.from_bytes(m["size"], "little")
        try:
            yield zlib.decompressobj(-15).decompress(content[a:], MOST_BYTES) if m["kind"] == b"\x08\x00" else content[a : a + size]
        except zlib.error:
            continue


def decode_hwpml(content: bytes, out: _Out) -> None:
    """Paragraphs and tables of the body's sections."""
    for section in _all(_xml(content), "SECTION"):
        for p in (x for x in section if _name(x) == "P"):
            _hwpx_paragraph(p, out)


def _number_text(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else clean_number(repr(value))


def decode_xls(content: bytes, out: _Out) -> None:
    """Each worksheet of a binary spreadsheet as a heading and a table."""
    try:
        package = ole.CompoundFile(content)
        book = package.stream("Workbook") or package.stream("Book")
        if book is None:
            raise DecodeError("PARSE_ERROR")
        for n, (name, cells, merges, _, styles, formats, date1904) in enumerate(xls.sheets(book), 1):
            out.block("heading", name, 2, n)
            texts: dict[tuple[int, int], str] = {}
            for place, (value, style) in cells.items():
                k = styles.get(style, 0)
                kind = "date" if k in DATE_FORMATS else "datetime" if k in TIME_FORMATS else date_kind(formats[k]) if k in formats else None
                if isinstance(value, bool):
                    texts[place] = "TRUE" if value else "FALSE"
                elif isinstance(value, float):
                    texts[place] = (serial_to_iso(value, date1904, kind) if kind else None) or _number_text(value)
                else:
                    texts[place] = str(value)
            filled = [r for (r, _), t in texts.items() if t.strip()]
            if not filled:
                continue
            top, bottom, width = min(filled), max(filled), max(c for (_, c), t in texts.items() if t.strip()) + 1
            spans = {(a, c): (d - c + 1, b - a + 1) for a, b, c, d in merges if a <= b and c <= d}
            hidden = {(r, c) for (a, c0), (w, h) in spans.items() for r in range(a, min(a + h, bottom + 1)) for c in range(c0, min(c0 + w, width))} - set(spans)
            out.table({(r - top, c): (texts.get((r, c), ""), *spans.get((r, c), (1, 1))) for r in range(top, bottom + 1) for c in range(width) if (r, c) not in hidden}, n)
    except (ole.OleError, xls.XlsError) as e:
        raise DecodeError(str(e)) from e


DECODERS: dict[str, Callable[[bytes, _Out], None]] = {"xls": decode_xls, "xlsx": decode_xlsx, "docx": decode_docx, "hwpx": decode_hwpx, "hwpml": decode_hwpml}


def decode(content: bytes | None, kind: str) -> dict:
    """One file's row."""
    out, error = _Out(), None
    if content and kind in ("hwpx", "hwp"):
        kind = zip_format(content) if kind == "hwpx" else ole.ole_format(content)
    try:
        if not content:
            raise DecodeError("EMPTY_INPUT")
        if kind not in DECODERS:
            raise DecodeError("UNSUPPORTED_FORMAT")
        DECODERS[kind](content, out)
    except DecodeError as e:
        error = str(e)
    except (ValueError, KeyError, IndexError, struct.error, RecursionError, OverflowError):
        error = "PARSE_ERROR"
    return {"format": kind, "blocks": out.blocks, "cells": out.cells, "title": out.title, "error": error}


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of spark.read.format("binaryFile") with format, blocks, cells, title and error; content is dropped."""
    from quire.functions.sniff import detect_format

    def run(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(c, k) for c, k in zip(content, kind, strict=True)], columns=["format", "blocks", "cells", "title", "error"])

    parsed = files.withColumn("p", F.pandas_udf(run, PARSED)("content", detect_format(F.col("content"))))
    return parsed.select(*[c for c in files.columns if c != "content"], "p.*")


def file_blocks(parsed: DataFrame, key: str = "path") -> DataFrame:
    """(key, block_id, type, text, level, page_number)."""
    return parsed.select(key, F.explode("blocks").alias("b")).select(key, "b.*")


def file_cells(parsed: DataFrame, key: str = "path") -> DataFrame:
    """(key, block_id, r, c, text, col_span, row_span)."""
    return parsed.select(key, F.explode("cells").alias("c")).select(key, "c.*")


def validate_hwpx(content: bytes | None) -> list[dict]:
    """What is wrong with an hwpx package: (code, detail)."""
    issues: list[dict] = []
    add = lambda code, detail="": issues.append({"code": code, "detail": detail})
    try:
        package = _Package(content or b"")
        if package.names[:1] != ["mimetype"]:
            add("MIMETYPE_FIRST", package.names[0] if package.names else "")
        if (package.read("mimetype") or b"").strip() != b"application/hwp+zip":
            add("MIMETYPE_CONTENT")
        for name in ("version.xml", "META-INF/container.xml", "Contents/content.hpf", "Contents/header.xml", "Contents/section0.xml"):
            if name not in package.names:
                add("MISSING", name)
        roots = {}
        for name in package.names:
            if name.endswith((".xml", ".hpf")):
                try:
                    roots[name] = package.xml(name)
                except DecodeError:
                    add("XML", name)
        sections = sum(bool(re.fullmatch(r"Contents/section\d+\.xml", n)) for n in package.names)
        if (head := roots.get("Contents/header.xml")) is not None and _attr(head, "secCnt") not in (None, str(sections)):
            add("SECTION_COUNT", f"{_attr(head, 'secCnt')} <> {sections}")
        if (hpf := roots.get("Contents/content.hpf")) is not None:
            for item in _all(hpf, "item"):
                href = _attr(item, "href") or ""
                if href and href not in package.names and f"Contents/{href}" not in package.names:
                    add("HREF", href)
    except DecodeError as e:
        add(str(e))
    return issues
