"""Words of whole texts as flat numpy arrays, taken straight from Arrow buffers.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these bytes never lie inside a longer character, so bytes and
characters give the same words. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes and words handled at once; bounds the memory of temporary arrays.
SLICE_BYTES = 1 << 19

#: Bytes of a span that the table of random values covers, by place and byte; longer spans are hashed one by one.
TABLED = 32
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, TABLED * 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the texts' bounds in it (one more than texts)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    if not len(column) or offsets[-1] == offsets[0] or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes, or of one longer text."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the texts' bounds counted in words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.ones(len(data) + 1, bool)  # a word may start at, or end before, this byte
    edge[1:-1] = ~inside[:-1] | ~inside[1:]
    edge[bounds] = True
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of byte spans that are in order and don't overlap.

    Each byte of a span adds a random value of its own place and kind, so that no pattern of bytes makes spans collide.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + block)))
        first, last = (starts[i:j] - base).astype(np.int32), int(ends[j - 1]) - base
        place = np.arange(last, dtype=np.int32) - np.repeat(first, np.diff(first, append=np.int32(last)))
        np.minimum(place, TABLED - 1, out=place)
        place <<= 8
        place |= data[base : base + last]
        sums = np.zeros(last + 1, np.uint64)
        np.cumsum(_TABLE[place], out=sums[1:])
        size = ends[i:j] - starts[i:j]
        out[i:j] = mix(sums[ends[i:j] - base] - sums[first] + size.astype(np.uint64))
        for k in (np.flatnonzero(size > TABLED) + i).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return out


def _followed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of a followed by b."""
    return mix(a * np.uint64(0x9E3779B97F4A7C17) + b)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive 64-bit values; gram i starts at value i. Grams of 1, 2, 4... values are put together to n."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    powers, size = [values], 1
    while 2 * size <= n:
        powers.append(_followed(powers[-1][:-size], powers[-1][size:]))
        size *= 2
    out, done = powers[-1], size
    while done < n:
        size = 1 << ((n - done).bit_length() - 1)
        more = powers[size.bit_length() - 1][done:]
        out, done = _followed(out[: len(more)], more), done + size
    return out[: len(values) - n + 1]


def hashed_words(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and the texts' bounds counted in words."""
    if lower:
        data = LOWER[data]
    starts, ends, at = word_spans(data, bounds)
    return span_hashes(data, starts, ends), at


def word_batches(ids: np.ndarray, column: pa.Array, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word hashes, bounds in words) of a few texts at a time."""
    data, bounds = text_bytes(column)
    for i, j in slices(bounds):
        yield ids[i:j], *hashed_words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower)
