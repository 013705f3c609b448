"""Media columns: ISO media containers, walked box by box without decoding what they hold.

probe() reads a container's bytes: it walks nested boxes (32-bit, 64-bit and open-ended sizes), decodes the sample tables of each
track and yields codec, duration and the byte ranges of keyframes; in fragmented files also those of the fragments (moof, with the
defaults of trex and tfhd). pack() writes payloads as 8-bit PCM samples into such a container, losslessly.

Defined results: null and empty media give null fields and no tracks; damaged containers give what could be read before the damage
and an error text, never an exception, and never take more memory than a few times their own size, whatever counts they claim; repeated rows give repeated results; an empty table gives an empty one; other columns stay,
and the result is one struct column under the name asked for, which replaces a column of that name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boxes that hold boxes.
CONTAINERS = frozenset(b"moov trak mdia minf stbl edts dinf udta mvex moof traf".split())
#: Bytes of a sample, and samples from one keyframe to the next, in what pack() writes.
SAMPLE_BYTES, KEY_EVERY, RATE = 192, 16, 8000
#: Deepest nesting that the walk follows.
MOST_DEPTH = 16

TRACKS = "array<struct<codec:string,timescale:long,duration:long,n_samples:long,media_bytes:long,first_byte:long,key_starts:array<long>,key_ends:array<long>>>"
PROBE = f"brand string, tracks {TRACKS}, error string"


def boxes(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, depth, first and last byte of the content) of each box, containers before what they hold."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} has size {size}, of {end - start} bytes left")
        yield kind, depth, start + head, start + size
        if kind in CONTAINERS and depth < MOST_DEPTH:
            yield from boxes(data, start + head, start + size, depth + 1)
        start += size


def _table(data: memoryview, at: int, end: int, columns: int, skip: int = 4, kind: str = ">u4") -> np.ndarray:
    """The entries of a full box: after version and flags (and more, by skip) their count, then columns values each."""
    n = struct.unpack_from(">I", data, at + skip)[0]
    if at + skip + 4 + n * columns * int(kind[2]) > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * columns, at + skip + 4).astype(np.int64).reshape(n, columns)


def sample_ranges(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all samples, from their sizes, the chunks' starts and the runs (first chunk, samples in each)."""
    if not len(sizes) or not len(chunks) or not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (lengths < 0).any():
        raise ValueError("chunk runs are out of order")
    each = np.minimum(np.repeat(runs[:, 1], lengths), len(sizes))  # no chunk has more than all
    upto = np.cumsum(each)
    if upto[-1] < len(sizes):
        raise ValueError("there are more samples than chunks hold")
    chunk = np.searchsorted(upto, np.arange(len(sizes)), "right")
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(len(each)))
    starts = chunks[chunk] + before - before[np.minimum(first, len(sizes) - 1)][chunk]
    return starts, starts + sizes


def _half_bytes(data: memoryview, at: int, end: int) -> np.ndarray:
    field, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if field == 4:
        packed = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12).astype(np.int64)
        return np.stack([packed >> 4, packed & 15], 1).reshape(-1)[:n]
    if field not in (8, 16) or at + 12 + n * field // 8 > end:
        raise ValueError("a compact size table is damaged")
    return np.frombuffer(data, f">u{field // 8}", n, at + 12).astype(np.int64)


class _Track:
    """What the boxes of one trak tell. most: the container's bytes, which no table of samples can outnumber."""

    def __init__(self, most: int) -> None:
        self.most, self.id, self.parts = most, 0, []
        self.codec, self.timescale, self.duration = None, None, None
        self.sizes = self.chunks = np.zeros(0, np.int64)
        self.runs, self.times, self.keys = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), None

    def read(self, kind: bytes, data: memoryview, at: int, end: int) -> None:
        if kind == b"tkhd":
            self.id = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"mdhd":
            wide = data[at] == 1
            self.timescale, self.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
            self.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            self.times = _table(data, at, end, 2)
        elif kind == b"stsc":
            self.runs = _table(data, at, end, 3)[:, :2]
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            if same and n * same > self.most:
                raise ValueError("a size table claims more than there is")
            self.sizes = np.full(n, same, np.int64) if same else _table(data, at, end, 1, 8)[:, 0]
        elif kind == b"stz2":
            self.sizes = _half_bytes(data, at, end)
        elif kind in (b"stco", b"co64"):
            self.chunks = _table(data, at, end, 1, kind=">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            self.keys = _table(data, at, end, 1)[:, 0] - 1

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Starts and ends of all samples, the places of keyframes, and the samples' whole duration."""
        starts, ends = sample_ranges(self.sizes, self.chunks, self.runs)
        keys = np.arange(len(starts)) if self.keys is None else self.keys[(self.keys >= 0) & (self.keys < len(starts))]
        length = int((self.times[:, 0] * self.times[:, 1]).sum()) if len(self.times) else 0
        for first, last, key, own in self.parts:
            keys = np.append(keys, np.flatnonzero(key) + len(starts))
            starts, ends, length = np.append(starts, first), np.append(ends, last), length + own
        return starts, ends, keys, length

    def result(self) -> dict:
        starts, ends, keys, length = self.ranges()
        duration = length if len(self.times) or self.parts else self.duration
        return {
            "codec": self.codec, "timescale": self.timescale, "duration": duration, "n_samples": len(starts) if self.parts else len(self.sizes), "media_bytes": int((ends - starts).sum()) if self.parts else int(self.sizes.sum()),
            "first_byte": int(starts[0]) if len(starts) else None, "key_starts": starts[keys].tolist(), "key_ends": ends[keys].tolist(),
        }


#: Flags of fragment boxes and of samples: fixed values of the format.
_BASE, _DURATION, _SIZE, _FLAGS, _MOOF_BASE = 0x1, 0x8, 0x10, 0x20, 0x20000
_RUN_OFFSET, _RUN_FIRST, _RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
_NO_KEY = 0x10000


class _Fragments:
    """Reads fragments into tracks: a trun's samples, with what trex and tfhd set for those that a run leaves out."""

    def __init__(self, tracks: list[_Track]) -> None:
        self.tracks, self.defaults, self.track, self.moof, self.at = tracks, {}, None, 0, 0

    def read(self, kind: bytes, data: memoryview, at: int, end: int) -> None:
        if kind == b"moof":
            self.moof, self.at = at - 8, at - 8
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
            self.defaults[track] = (duration, size, flags)
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">II", data, at)
            values, place = list(self.defaults.get(track, (0, 0, 0))), at + 8
            if flags & _BASE:
                self.at = struct.unpack_from(">Q", data, place)[0]
                place += 8
            elif flags & _MOOF_BASE:
                self.at = self.moof
            place += 4 * bool(flags & 2)
            for k, bit in enumerate((_DURATION, _SIZE, _FLAGS)):
                if flags & bit:
                    values[k] = struct.unpack_from(">I", data, place)[0]
                    place += 4
            self.base, self.values = self.at, values
            self.track = next((t for t in self.tracks if t.id == track), None)
        elif kind == b"trun" and self.track is not None:
            self._run(data, at, end)

    def _run(self, data: memoryview, at: int, end: int) -> None:
        flags, n = struct.unpack_from(">II", data, at)
        flags &= 0xFFFFFF
        place, first = at + 8, None
        if flags & _RUN_OFFSET:
            self.at = self.base + struct.unpack_from(">i", data, place)[0]
            place += 4
        if flags & _RUN_FIRST:
            first = struct.unpack_from(">I", data, place)[0]
            place += 4
        columns = [bit for bit in (_RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT) if flags & bit]
        if place + 4 * n * len(columns) > end or not flags & _RUN_SIZE and n * max(1, self.values[1]) > self.track.most:
            raise ValueError("a fragment's run claims more than there is")
        table = np.frombuffer(data, ">u4", n * len(columns), place).astype(np.int64).reshape(n, len(columns))
        duration, size, own = (table[:, columns.index(bit)] if flags & bit else np.full(n, default) for bit, default in zip((_RUN_DURATION, _RUN_SIZE, _RUN_FLAGS), self.values, strict=True))
        if first is not None and n:
            own = np.append(first, own[1:])
        ends = self.at + np.cumsum(size)
        self.track.parts.append((ends - size, ends, own & _NO_KEY == 0, int(duration.sum())))
        self.at = int(ends[-1]) if n else self.at


def probe_bytes(media: bytes | None) -> dict:
    """brand, tracks and error of one container."""
    out: dict = {"brand": None, "tracks": [], "error": None}
    if not media:
        return out
    data, tracks = memoryview(media), []
    fragments = _Fragments(tracks)
    try:
        for kind, _, at, end in boxes(data, 0, len(data)):
            if kind == b"ftyp":
                out["brand"] = bytes(data[at : at + 4]).decode("latin-1")
            elif kind == b"trak":
                tracks.append(_Track(len(data)))
            elif kind in (b"moof", b"trex", b"tfhd", b"trun"):
                fragments.read(kind, data, at, end)
            elif tracks:
                tracks[-1].read(kind, data, at, end)
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        out["error"] = str(e)
    for track in tracks:
        try:
            out["tracks"].append(track.result())
        except (ValueError, IndexError, OverflowError) as e:
            out["error"] = out["error"] or str(e)
    return out


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *values: int, tail: bytes = b"") -> bytes:
    return _box(kind, struct.pack(f">{len(values) + 1}I", 0, *values), tail)


#: A transformation that changes nothing, as the headers ask for one: fixed values.
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pack_bytes(payload: bytes) -> bytes:
    """payload, a multiple of SAMPLE_BYTES long, as the mono 8-bit track of a container."""
    n = len(payload) // SAMPLE_BYTES
    if n * SAMPLE_BYTES != len(payload):
        raise ValueError(f"the payload isn't a multiple of {SAMPLE_BYTES} bytes")
    length, wide = n * SAMPLE_BYTES, len(payload) > (1 << 32) - 4096
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", struct.pack(">6xH", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    start = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")

    def moov(first: int) -> bytes:
        tables = _box(
            b"stbl", _full(b"stsd", 1, tail=entry), _full(b"stts", 1, n, SAMPLE_BYTES), _full(b"stsc", 1, 1, n, 1), _full(b"stsz", SAMPLE_BYTES, n),
            _box(b"co64", struct.pack(">IIQ", 0, 1, first)) if wide else _full(b"stco", 1, first), _full(b"stss", len(keys), tail=keys.tobytes()),
        )
        handler = _box(b"hdlr", struct.pack(">II4s12x", 0, 0, b"soun"), b"\0")
        minf = _box(b"minf", _full(b"smhd", 0), _box(b"dinf", _full(b"dref", 1, tail=_box(b"url ", struct.pack(">I", 1)))), tables)
        if length < 1 << 32:
            times = _full(b"mdhd", 0, 0, RATE, length, 0x55C40000)
        else:
            times = _box(b"mdhd", struct.pack(">IQQIQI", 1 << 24, 0, 0, RATE, length, 0x55C40000))
        shown = min(length, (1 << 32) - 1)
        mvhd = _full(b"mvhd", 0, 0, RATE, shown, 0x10000, tail=struct.pack(">H10x", 0x100) + _MATRIX + struct.pack(">24xI", 2))
        tkhd = _box(b"tkhd", struct.pack(">IIIII", 3, 0, 0, 1, 0), struct.pack(">I8xHHHH", shown, 0, 0, 0x100, 0), _MATRIX, struct.pack(">II", 0, 0))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", times, handler, minf)))

    first = len(start) + len(moov(0)) + (16 if wide else 8)
    return start + moov(first) + _box(b"mdat", payload)


def track_bytes(media: bytes, track: int = 0) -> bytes:
    """The samples of a track, in order, as read back from the container."""
    data, seen = memoryview(media), -1
    found = _Track(len(data))
    for kind, _, at, end in boxes(data, 0, len(data)):
        seen += kind == b"trak"
        if seen == track:
            found.read(kind, data, at, end)
    starts, ends = sample_ranges(found.sizes, found.chunks, found.runs)
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    firsts, lasts = starts[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)]
    if lasts.max() > len(data):
        raise ValueError("samples lie beyond the end")
    return b"".join(data[a:b] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


def pad(text: str | None) -> bytes:
    """The text in UTF-8, then blanks up to a positive multiple of SAMPLE_BYTES."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // SAMPLE_BYTES)) * SAMPLE_BYTES, b" ")


def pack_text(text: str | Column) -> Column:
    """Whole texts (null: empty), padded, as containers."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: pack_bytes(pad(x)))

    return run(text)


def probe(media: str | Column) -> Column:
    """The struct (brand, tracks, error) of a binary column."""

    @F.pandas_udf(PROBE)
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([probe_bytes(x) for x in column], columns=["brand", "tracks", "error"])

    return run(media)


def feature(found: dict) -> str:
    """A probe's first track in a line of text."""
    if not found["tracks"]:
        return f"none;error={found['error'] or ''}"
    t = found["tracks"][0]
    keys = ",".join(f"{a}-{b}" for a, b in zip(t["key_starts"], t["key_ends"], strict=True))
    return f"codec={t['codec'].strip()};timescale={t['timescale']};duration={t['duration']};samples={t['n_samples']};keys={keys}"
