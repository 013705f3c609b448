"""Hashed tables of numpy arrays, for looking up many keys at a time."""

from __future__ import annotations

import numpy as np

from quire.llm.text import span_hashes

#: Bytes at either end of a span that are compared as one number.
_EDGE = 8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(_EDGE + 1)], np.uint64)


class Table:
    """Whole numbers by 64-bit key, looked up many at a time. A key lies in the first free slot from its own on; a third of the slots are used at most."""

    def __init__(self, log2: int) -> None:
        self.log2, self.n = log2, 0
        self.keys, self.values = np.zeros(1 << log2, np.uint64), np.full(1 << log2, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log2)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        slot, last = self._slots(keys), len(self.keys) - 1
        out = self.values[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(rest):  # what lies in another key's slot goes one slot on
            slot[rest] = (slot[rest] + 1) & last
            out[rest] = self.values[slot[rest]]
            rest = rest[(out[rest] >= 0) & (self.keys[slot[rest]] != keys[rest])]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet, with values from 0 on."""
        if (self.n + len(keys)) * 3 > len(self.keys):
            known, held = self.values >= 0, (self.keys, self.values)
            n = self.n + len(keys)
            self.__init__(max(self.log2 + 1, (n * 3).bit_length()))
            self._place(held[0][known], held[1][known])
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, last, rest = self._slots(keys), len(self.keys) - 1, np.arange(len(keys))
        while len(rest):
            own = slot[rest]
            free = np.flatnonzero(self.values[own] < 0)
            _, first = np.unique(own[free], return_index=True)  # one key a slot
            put = free[first]
            self.keys[own[put]], self.values[own[put]] = keys[rest[put]], values[rest[put]]
            rest = np.delete(rest, put)
            slot[rest] = (slot[rest] + (self.keys[slot[rest]] != keys[rest])) & last
        self.n += len(keys)


class Collision(Exception):
    """Two different spans have one hash."""


def _edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last bytes of spans as numbers; with the length they settle spans of up to twice as many bytes."""
    padded = np.concatenate([np.zeros(_EDGE, np.uint8), data, np.zeros(_EDGE, np.uint8)])
    words = np.ndarray(len(padded) - _EDGE + 1, "<u8", padded.data, strides=(1,))
    size = np.minimum(ends - starts, _EDGE)
    return words[starts + _EDGE] & _MASKS[size], words[ends] >> (np.uint64(8) * (_EDGE - size).astype(np.uint64))


def grown(held: np.ndarray, n: int, most: int) -> np.ndarray:
    """The first n values, with room for half as many again as `most`."""
    return np.concatenate([held[:n], np.zeros(most + (most >> 1) - n, held.dtype)])


class SpanCache:
    """Lists of whole numbers by 64-bit hash: what was worked out once in a process isn't again, until `most` are held and all are let go."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = Table(16), 0, 0
        self.starts, self.sizes, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of distinct hashes; -1 for those that aren't held."""
        places = self.table.get(hashes)
        if self.n + int((places < 0).sum()) > self.most and self.n:
            self.clear()
            places = np.full(len(hashes), -1, np.int32)
        return places

    def add(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Holds lists that aren't held yet, one after the other; their places."""
        n, used = self.n + len(hashes), self.used + len(flat)
        for name in ("starts", "sizes"):
            if n > len(getattr(self, name)):
                setattr(self, name, grown(getattr(self, name), self.n, n))
        if used > len(self.flat):
            self.flat = grown(self.flat, self.used, used)
        own = slice(self.n, n)
        self.sizes[own], self.starts[own] = sizes, self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : used] = flat
        places = np.arange(self.n, n)
        self.table.put(hashes, places.astype(np.int32))
        self.n, self.used = n, used
        return places

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of values of each place, and all values in order."""
        n = self.sizes[places].astype(np.int64)
        return n, self.flat[np.repeat(self.starts[places] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class ByteSpanCache(SpanCache):
    """Encoded spans of bytes, found by hash and compared by their bytes."""

    def clear(self) -> None:
        super().clear()
        self.heads, self.tails, self.lengths = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.long: dict[int, bytes] = {}

    def find_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct spans' places (-1: not held), the first span of each, and the distinct one of every span. Collision if hashes of unequal spans are equal."""
        hashes, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        heads, tails = _edges(data, starts, ends)
        length = ends - starts
        alike = first[back]
        if (heads != heads[alike]).any() or (tails != tails[alike]).any() or (length != length[alike]).any():
            raise Collision
        span = lambda k: data[starts[k] : ends[k]].tobytes()
        long = length > 2 * _EDGE
        if any(span(k) != span(alike[k]) for k in np.flatnonzero(long & (alike != np.arange(len(starts)))).tolist()):
            raise Collision
        places = self.find(hashes)
        held = np.flatnonzero(places >= 0)
        at, own = places[held], first[held]
        if (self.heads[at] != heads[own]).any() or (self.tails[at] != tails[own]).any() or (self.lengths[at] != length[own]).any():
            raise Collision
        if any(self.long[p] != span(k) for p, k in zip(at[long[own]].tolist(), own[long[own]].tolist(), strict=True)):
            raise Collision
        self.new = np.flatnonzero(places < 0)
        own = first[self.new]
        self._fresh = hashes[self.new], heads[own], tails[own], length[own], {k: span(j) for k, j in enumerate(own.tolist()) if long[j]}
        return places, first, back

    def add_spans(self, order: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Holds the spans that find_spans() has just missed, in an order, with their values one after the other; their places in that order."""
        hashes, heads, tails, lengths, long = self._fresh
        n = self.n + len(order)
        for name in ("heads", "tails", "lengths"):
            if n > len(getattr(self, name)):
                setattr(self, name, grown(getattr(self, name), self.n, n))
        own = slice(self.n, n)
        self.heads[own], self.tails[own], self.lengths[own] = heads[order], tails[order], lengths[order]
        places = self.add(hashes[order], sizes, flat)
        if long:
            self.long |= {int(p): long[k] for p, k in zip(places, order.tolist(), strict=True) if k in long}
        return places
