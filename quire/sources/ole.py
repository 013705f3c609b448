"""Compound files (OLE2): their directory and streams, read with limits and without trust in what they claim."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Ends of chains and free sectors (fixed values), and limits: sectors of a chain, entries, bytes of a stream.
END, FREE, MOST_SECTORS, MOST_ENTRIES, MOST_STREAM = 0xFFFFFFFE, 0xFFFFFFFA, 1 << 20, 10_000, 100 << 20


class OleError(Exception):
    """The file can't be read as a compound file."""


class CompoundFile:
    """A compound file's entries by name. Sectors beyond the end read as cut off; chains that meet themselves end there."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or data[:8] != MAGIC:
            raise OleError("CORRUPTED")
        self.data = data
        shift, self.mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or self.mini_shift != 6:
            raise OleError("CORRUPTED")
        self.size = 1 << shift
        n_fat, first_dir, _, self.cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<IIIIIIII", data, 44)
        tables = [x for x in struct.unpack_from("<109I", data, 76) if x < FREE]
        seen: set[int] = set()
        while first_more < FREE and first_more not in seen and len(seen) <= min(n_more, 1 << 12):
            seen.add(first_more)
            sector = self._sector(first_more).ljust(self.size, b"\xff")
            *more, first_more = struct.unpack(f"<{self.size // 4}I", sector)
            tables += [x for x in more if x < FREE]
        fat = b"".join(self._sector(x) for x in tables[: n_fat or None])
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat[: len(fat) // 4 * 4])
        directory = self._chain(first_dir)
        self.entries: list[tuple[str, int, int, int]] = []
        for at in range(0, min(len(directory), MOST_ENTRIES * 128) - 127, 128):
            length, kind = struct.unpack_from("<HB", directory, at + 64)
            first, size = struct.unpack_from("<IQ", directory, at + 116)
            if kind in (1, 2, 5):
                name = directory[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
                self.entries.append((name, kind, first, size & 0xFFFFFFFF if shift == 9 else size))
        root = next((e for e in self.entries if e[1] == 5), None)
        self.mini = self._chain(root[2]) if root else b""
        mini_fat = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(mini_fat) // 4}I", mini_fat[: len(mini_fat) // 4 * 4])

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _walk(self, first: int, table: tuple[int, ...]) -> list[int]:
        out, seen = [], set()
        while first < FREE and first not in seen and len(out) < MOST_SECTORS:
            seen.add(first)
            out.append(first)
            first = table[first] if first < len(table) else END
        return out

    def _chain(self, first: int) -> bytes:
        return b"".join(self._sector(x) for x in self._walk(first, self.fat))

    def names(self) -> list[str]:
        return [e[0] for e in self.entries]

    def stream(self, name: str) -> bytes | None:
        """A stream's bytes, or None."""
        entry = next((e for e in self.entries if e[0] == name and e[1] == 2), None)
        if entry is None:
            return None
        _, _, first, size = entry
        if size > MOST_STREAM:
            raise OleError("TOO_LARGE")
        if size < self.cutoff:
            return b"".join(self.mini[x << 6 : (x + 1) << 6] for x in self._walk(first, self.mini_fat))[:size]
        return self._chain(first)[:size]


def ole_format(data: bytes) -> str:
    """xls, hwp or unknown, by the names of entries."""
    try:
        names = CompoundFile(data).names()
    except (OleError, struct.error, IndexError):
        return "unknown"
    if {"Workbook", "Book"} & set(names):
        return "xls"
    return "hwp" if any(n in ("FileHeader", "DocInfo") or n.startswith("Section") for n in names) else "unknown"
