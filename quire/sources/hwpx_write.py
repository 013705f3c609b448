"""Writing hwpx packages from markdown: headings, paragraphs, lists and tables as a section that the decoder reads back."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.operators.markdown import inline_spans, parse_blocks

#: Name spaces and fixed parts of a package (fixed values of the format).
_HP, _HS, _HH, _OPF = (f"http://www.hancom.co.kr/hwpml/2011/{x}" for x in ("paragraph", "section", "head", "package"))
_CONTAINER = '<?xml version="1.0" encoding="UTF-8"?><container><rootfiles><rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></rootfiles></container>'
_VERSION = '<?xml version="1.0" encoding="UTF-8"?><HCFVersion tagetApplication="WORDPROCESSOR" major="5" minor="1"/>'
_MANIFEST = (
    f'<?xml version="1.0" encoding="UTF-8"?><opf:package xmlns:opf="{_OPF}"><opf:manifest><opf:item id="header" href="Contents/header.xml" media-type="application/xml"/>'
    '<opf:item id="section0" href="Contents/section0.xml" media-type="application/xml"/></opf:manifest><opf:spine><opf:itemref idref="section0"/></opf:spine></opf:package>'
)
_STAMP = (1980, 1, 1, 0, 0, 0)


def _paragraph(text: str, inner: str = "") -> str:
    plain = "".join(s["text"] for s in inline_spans(text))
    return f'<hp:p paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t>{escape(plain)}</hp:t>{inner}</hp:run></hp:p>'


def _table(markdown: str) -> str:
    rows = [re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|")) for k, line in enumerate(markdown.split("\n")) if k != 1]
    cols = max(map(len, rows))
    cell = lambda r, c, t: f'<hp:tc><hp:subList>{_paragraph(t.strip().replace(chr(92) + "|", "|"))}</hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc>'
    body = "".join("<hp:tr>" + "".join(cell(r, c, (row + [""] * cols)[c]) for c in range(cols)) + "</hp:tr>" for r, row in enumerate(rows))
    return _paragraph("", f'<hp:tbl rowCnt="{len(rows)}" colCnt="{cols}">{body}</hp:tbl>')


def markdown_to_hwpx(text: str | None) -> bytes:
    """A package with the text as its one section; equal texts give equal bytes."""
    parts = []
    for b in parse_blocks(text):
        body = b["text"] or ""
        if b["type"] == "table":
            parts.append(_table(body))
        elif b["type"] == "list_item":
            parts.append(_paragraph("  " * b["list_depth"] + "- " + body))
        elif b["type"] != "separator":
            parts += [_paragraph(line) for line in body.split("\n")]
    section = f'<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="{_HS}" xmlns:hp="{_HP}">{"".join(parts) or _paragraph("")}</hs:sec>'
    header = f'<?xml version="1.0" encoding="UTF-8"?><hh:head xmlns:hh="{_HH}" version="1.4" secCnt="1"/>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, data in (("mimetype", "application/hwp+zip"), ("version.xml", _VERSION), ("META-INF/container.xml", _CONTAINER), ("Contents/content.hpf", _MANIFEST), ("Contents/header.xml", header), ("Contents/section0.xml", section)):
            package.writestr(zipfile.ZipInfo(name, _STAMP), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def generated_hwpx(text: str | Column) -> Column:
    """markdown_to_hwpx() of a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(markdown_to_hwpx)

    return F.pandas_udf(run, "binary")(text)
