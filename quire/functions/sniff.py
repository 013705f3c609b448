"""File formats by their first bytes, as Spark columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _starts(content: Column, magic: bytes, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(magic))) == magic.hex().upper()


def is_zip(content: Column) -> Column:
    return _starts(content, b"PK\x03\x04")


def is_ole2(content: Column) -> Column:
    return _starts(content, b"\xd0\xcf\x11\xe0")


def is_pdf(content: Column) -> Column:
    return _starts(content, b"%PDF")


def is_hwp3(content: Column) -> Column:
    return _starts(content, b"HWP Document File V3.00")


def is_hwpml(content: Column) -> Column:
    """An XML declaration, and the root's name within 512 bytes."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")  # never malformed; a UTF-8 mark reads as three characters
    return head.rlike(r"^(?:\xEF\xBB\xBF)?\s*<\?xml") & head.contains("<HWPML")


def is_image(content: Column) -> Column:
    """PNG, JPEG or WebP of twelve bytes or more."""
    webp = _starts(content, b"RIFF") & _starts(content, b"WEBP", 9)
    return (F.length(content) >= 12) & (_starts(content, b"\x89PNG") | _starts(content, b"\xff\xd8\xff") | webp)


def detect_format(content: Column) -> Column:
    """The format's name; zip and OLE2 files count as hwpx and hwp until their entries are read."""
    order = [(is_hwp3, "hwp3"), (is_zip, "hwpx"), (is_ole2, "hwp"), (is_pdf, "pdf"), (is_hwpml, "hwpml"), (is_image, "image")]
    out = F.when(content.isNull() | (F.length(content) < 4), "unknown")
    for test, name in order:
        out = out.when(test(content), name)
    return out.otherwise("unknown")


def image_mime(content: Column) -> Column:
    """The media type of an image, or null."""
    return (
        F.when(_starts(content, b"\x89PNG"), "image/png").when(_starts(content, b"\xff\xd8\xff"), "image/jpeg").when(_starts(content, b"GIF8"), "image/gif")
        .when(_starts(content, b"BM"), "image/bmp").when(_starts(content, b"RIFF") & _starts(content, b"WEBP", 9), "image/webp")
    )


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    digits = F.hex(F.substring(content, at, size))
    if little:
        digits = F.concat(*[F.substring(digits, k * 2 + 1, 2) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("long")


def frame_size(jpeg: bytes | None) -> tuple[int, int] | None:
    """Width and height of the first frame header of a JPEG file; null without one. Bytes outside of segments are skipped."""
    at, frames = 2, {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
    while jpeg and at + 9 < len(jpeg):
        if jpeg[at] != 0xFF:
            found = jpeg.find(b"\xff", at)
            at = found if found >= 0 else len(jpeg)
        elif jpeg[at + 1] in frames:
            return int.from_bytes(jpeg[at + 7 : at + 9]), int.from_bytes(jpeg[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(jpeg[at + 2 : at + 4])
    return None


def image_size(content: Column) -> Column:
    """The struct (width, height) by a PNG, JPEG, GIF or BMP header; null where it is none or cut short."""

    @F.pandas_udf("width long, height long")
    def frames(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([frame_size(x) or (None, None) for x in files], columns=["width", "height"]).astype("Int64")

    pair = lambda w, h: F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("width"), h.alias("height")))
    long = lambda n: F.length(content) >= n
    raw = _number(content, 23, 4, True)
    found = frames(F.when(_starts(content, b"\xff\xd8"), content))
    return (
        F.when(_starts(content, b"\x89P") & long(24), pair(_number(content, 17, 4), _number(content, 21, 4)))
        .when(_starts(content, b"GI") & long(10), pair(_number(content, 7, 2, True), _number(content, 9, 2, True)))
        .when(_starts(content, b"BM") & long(26), pair(_number(content, 19, 4, True), F.abs(F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw))))
        .when(_starts(content, b"\xff\xd8"), pair(found["width"], found["height"]))
    )
