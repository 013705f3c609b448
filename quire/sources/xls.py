"""Old binary spreadsheets (BIFF8): sheets with their cells, shared strings over continued records, dates and merged areas."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Record numbers (fixed values of the format).
BOF, EOF, SHEET, STRINGS, CONTINUE, LABEL_SST, NUMBER, RK, MULTI_RK, FORMULA, STRING, LABEL, BOOL_ERR, MERGES, FORMAT, XF, DATE_1904, FILE_PASS = (
    0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x204, 0x205, 0xE5, 0x41E, 0xE0, 0x22, 0x2F,
)
#: Codes of error values (fixed values of the format).
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
MOST_SHEETS, MOST_ROWS, MOST_COLS = 100, 65_536, 1000


class XlsError(Exception):
    """An error code."""


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(place, number, content) of each whole record."""
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        if at + 4 + size > len(data):
            return
        yield at, kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def decode_rk(value: int) -> float:
    """A packed number: 30 bits as an integer or as the head of a double; the lowest bit means hundredths."""
    if value & 2:
        number = float((value >> 2) - (1 << 30 if value & 0x80000000 else 0))
    else:
        number = struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


class _Parts:
    """A record and its continuations, read as one; text that goes on in a new part says anew how wide its characters are."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def _more(self) -> bool:
        while self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        return self.part < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self._more():
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
        if len(out) < n:
            raise XlsError("CORRUPTED")
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
                if not self._more():
                    raise XlsError("CORRUPTED")
                wide = self.take(1)[0] & 1
            if not self._more():
                raise XlsError("CORRUPTED")
            room = (len(self.parts[self.part]) - self.at) // (2 if wide else 1)
            k = min(n, room)
            if not k:
                raise XlsError("CORRUPTED")
            out.append(self.take(k * 2).decode("utf-16-le", "replace") if wide else self.take(k).decode("latin-1"))
            n -= k
        self.take(4 * runs + extra)
        return "".join(out)


def _short_text(data: bytes, at: int, wide_count: bool) -> str:
    n = struct.unpack_from("<H" if wide_count else "<B", data, at)[0]
    at += 2 if wide_count else 1
    flags = data[at]
    return data[at + 1 : at + 1 + 2 * n].decode("utf-16-le", "replace") if flags & 1 else data[at + 1 : at + 1 + n].decode("latin-1")


def shared_strings(parts: list[bytes]) -> list[str]:
    reader = _Parts(parts)
    _, unique = struct.unpack("<II", reader.take(8))
    out: list[str] = []
    try:
        while len(out) < unique:
            out.append(reader.text())
    except XlsError:  # what could be read before the damage
        return out
    return out


def sheets(book: bytes) -> Iterator[tuple[str, dict[tuple[int, int], tuple[object, int]], list[tuple[int, int, int, int]], list[str], dict[int, int], dict[int, str], bool]]:
    """(name, cells (value, style) by place, merged areas, shared strings, format of each style, formats' codes, 1904 dates) of each worksheet."""
    names, strings, formats, styles, date1904 = [], [], {}, {}, False
    first, going = True, False
    for _, kind, body in records(book):
        if first:
            if kind != BOF or len(body) < 4 or struct.unpack_from("<H", body)[0] != 0x600:
                raise XlsError("UNSUPPORTED_FORMAT")
            first = False
        if kind == FILE_PASS:
            raise XlsError("ENCRYPTED")
        if kind == CONTINUE and going:
            strings.append(body)
            continue
        going = kind == STRINGS
        if kind == STRINGS:
            strings = [body]
        elif kind == SHEET and len(body) > 8 and body[5] == 0:
            names.append((struct.unpack_from("<I", body)[0], _short_text(body, 6, False)))
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", body)[0]] = _short_text(body, 2, True)
        elif kind == XF:
            styles[len(styles)] = struct.unpack_from("<H", body, 2)[0]
        elif kind == DATE_1904:
            date1904 = bool(struct.unpack_from("<H", body)[0])
        elif kind == EOF:
            break
    shared = shared_strings(strings) if strings else []
    for at, name in names[:MOST_SHEETS]:
        yield name, *_cells(book, at, shared), shared, styles, formats, date1904


def _cells(book: bytes, at: int, shared: list[str]) -> tuple[dict, list]:
    cells: dict[tuple[int, int], tuple[object, int]] = {}
    merges, depth, waiting = [], 0, None
    for _, kind, body in records(book, at):
        if kind == BOF:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if depth <= 0:
                break
        if depth != 1:
            continue
        try:
            if kind in (LABEL_SST, NUMBER, RK, FORMULA, LABEL, BOOL_ERR):
                r, c, style = struct.unpack_from("<HHH", body)
                value: object = None
                if kind == LABEL_SST:
                    k = struct.unpack_from("<I", body, 6)[0]
                    value = shared[k] if k < len(shared) else ""
                elif kind == NUMBER:
                    value = struct.unpack_from("<d", body, 6)[0]
                elif kind == RK:
                    value = decode_rk(struct.unpack_from("<I", body, 6)[0])
                elif kind == LABEL:
                    value = _short_text(body, 6, True)
                elif kind == BOOL_ERR:
                    value = ERRORS.get(body[6], "#ERR") if body[7] else bool(body[6])
                elif body[12:14] != b"\xff\xff":
                    value = struct.unpack_from("<d", body, 6)[0]
                elif body[6] == 0:
                    waiting = (r, c, style)  # its text comes in a record of its own
                elif body[6] in (1, 2):
                    value = bool(body[8]) if body[6] == 1 else ERRORS.get(body[8], "#ERR")
                if value is not None and r < MOST_ROWS and c < MOST_COLS:
                    cells[r, c] = (value, style)
            elif kind == STRING and waiting:
                cells[waiting[:2]] = (_short_text(body, 0, True), waiting[2])
                waiting = None
            elif kind == MULTI_RK:
                r, c = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, packed = struct.unpack_from("<HI", body, 4 + 6 * k)
                    cells[r, c + k] = (decode_rk(packed), style)
            elif kind == MERGES:
                n = struct.unpack_from("<H", body)[0]
                merges += [struct.unpack_from("<4H", body, 2 + 8 * k) for k in range(n)]
        except (struct.error, IndexError):
            continue
    return cells, merges
