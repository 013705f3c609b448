"""SentencePiece encoding and decoding in batched numpy Viterbi.

A text becomes a string of bytes in which a blank stands for the piece mark; it is cut into words before each blank that follows another
byte (no piece crosses there, which is checked when a model is read). Distinct words of equal length form a matrix and advance together:
at each end position, the hashes of the substrings that end there probe the sorted keys of the pieces of that length, and the maximum
over the lengths stores the backpointer.

What is maximised depends on the kind of model. For a unigram model it is the sum of the pieces' scores. A byte-pair model's encoding isn't
a best sum; but a sequence of pieces is its encoding exactly if each two neighbours, joined and encoded alone, stay two pieces, and each
prefix has one last piece for which that holds. So the state of a position is that last piece, candidates whose pair with the state before
them doesn't hold count as minus infinity, and answers for pairs are kept in a sorted table. Words in which no state survives, and words
that start with several blanks (equal scores there are settled by position), are merged one by one.

Defined results: null texts count as empty and have no pieces; characters that no piece covers become byte pieces, or the unknown piece in a
model without them; the piece mark in a text is the same as a blank, as in the library; words of any length are encoded whole; decode()
takes no unknown ids (ValueError) and gives back the text but for the two points before.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import bound_batches, lean
from quire.llm.table import ByteSpanCache, Collision, Table
from quire.llm.text import slices, text_bytes

UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁".encode()
#: Cells of a batch's matrix, bytes of text encoded at once, pairs that are kept at most (then the table starts anew).
CELLS, TEXT_BYTES, MOST_PAIRS = 1 << 18, 2 << 20, 1 << 19
#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0

#: Hashes of substrings are sums of the bytes' random values, weighed by powers of a ratio: good for pieces, which are short.
_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_RATIO = 0x9E3779B97F4A7C15


@cache
def _power_block(log2: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << log2, _RATIO, np.uint64), np.full(1 << log2, pow(_RATIO, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or some more, of the ratio and of its inverse, modulo 2**64."""
    return _power_block(max(6, (n - 1).bit_length()))


def _fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n


@dataclass
class Model:
    """What a .model file holds, and tables made from it."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray
    kind: int = UNIGRAM
    prefix: bool = True
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    bytes_at: int = -1
    unknown: int = 0
    pairs: Table = field(default_factory=lambda: Table(18))
    known: ByteSpanCache = field(default_factory=ByteSpanCache)

    @classmethod
    def read(cls, data: bytes) -> Model:
        """A model from its file's bytes; only models that don't normalise texts are taken."""
        pieces, scores, kinds, options = [], [], [], {"prefix": True, "squeeze": True, "map": b"", "kind": UNIGRAM}
        for number, value in _fields(memoryview(data)):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(bytes(own.get(1, b"")))
                scores.append(own.get(2, 0.0))
                kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                options["kind"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                options |= {"map": bytes(own.get(2, b"")), "prefix": bool(own.get(3, 1)), "squeeze": bool(own.get(4, 1))}
        if options["map"] or options["squeeze"] or options["kind"] not in (UNIGRAM, BPE) or _USER in kinds:
            raise ValueError("only unigram and byte-pair models without normalisation, squeezing and user-defined pieces are supported")
        model = cls([p.replace(MARK, b" ") for p in pieces], np.array(scores, np.float64), np.array(kinds), options["kind"], options["prefix"])
        normal = [i for i in range(len(pieces)) if kinds[i] == _NORMAL]
        if any(b" " in model.pieces[i].lstrip(b" ") for i in normal):
            raise ValueError("a piece crosses words")
        known = {model.pieces[i] for i in normal}
        if model.kind == BPE and any(c.encode() not in known for i in normal for c in model.pieces[i].decode()):
            raise ValueError("a piece has a character that is no piece")
        if _BYTE in kinds:
            model.bytes_at = kinds.index(_BYTE)
            if kinds[model.bytes_at : model.bytes_at + 256] != [_BYTE] * 256:
                raise ValueError("byte pieces are out of order")
            for b in range(256):
                model.pieces[model.bytes_at + b] = bytes([b])
        model.unknown = kinds.index(_UNKNOWN)
        by_length: list[list[int]] = [[] for _ in range(max(len(model.pieces[i]) for i in normal) + 1)]
        for i in normal:
            by_length[len(model.pieces[i])].append(i)
        for length, own in enumerate(by_length):
            ids = np.array(own, np.int64)
            flat = np.frombuffer(b"".join(model.pieces[i] for i in own), np.uint8).reshape(len(own), length)
            keys = (_BYTE_VALUES[flat] * _powers(max(1, length))[0][:length]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(keys)
            model.keys.append((keys[order], ids[order]))
            if len(own):
                model.lengths.append(length)
        model._index = {model.pieces[i]: i for i in normal}
        return model

    def probe(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Pieces of a length by key, or -1."""
        known, ids = self.keys[length]
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, ids[at], -1)

    def merged(self, word: bytes) -> list[int]:
        """The byte-pair encoding of one word: the best-scored pair of neighbours is joined, the leftmost of equals, until none can be. -1: unknown characters."""
        parts = [c.encode() for c in word.decode("utf-8", "replace")]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap: list[tuple[float, int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (p := self._index.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[p], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, b""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self._index.get(p, -1) for p in parts if p]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces, joined and encoded alone, stay these two; left -2: whether right alone stays whole; -1, an unknown character, holds with all."""
        n = len(self.pieces)
        out = np.ones(len(left), bool)
        asked = np.flatnonzero((left != -1) & (right != -1))
        key = ((left[asked] + 2) * n + right[asked]).astype(np.uint64)
        holds = self.pairs.get(key)
        new = np.unique(key[holds < 0])
        if len(new):
            found = []
            for k in new.tolist():
                a, b = k // n - 2, k % n
                found.append(self.merged(self.pieces[b]) == [b] if a == -2 else self.merged(self.pieces[a] + self.pieces[b]) == [a, b])
            again = holds < 0
            holds[again] = np.array(found, np.int32)[np.searchsorted(new, key[again])]
            if self.pairs.n > MOST_PAIRS:
                self.pairs = Table(18)
            self.pairs.put(new, np.array(found, np.int32))
        out[asked] = holds > 0
        return out

    def _advance(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of one length (a matrix of bytes): at each end, the last piece's length (0: none) and id."""
        n, width = words.shape
        up, down = _powers(width)
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_BYTE_VALUES[words] * up[:width], axis=1, out=sums[:, 1:])
        starts = np.ones((n, width + 1), bool)  # where a character begins, and the end
        starts[:, :-1] = words & 0xC0 != 0x80
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, last = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -2)
        worst = self.scores[self.kinds == _NORMAL].min() - UNKNOWN_PENALTY
        longest = max(4, self.lengths[-1])
        sizes = sorted({*self.lengths, 1, 2, 3, 4})  # an unknown character has up to four bytes
        ahead = np.full((n, width + 2), 0)  # the next place where a character begins
        ahead[:, width] = width
        for j in range(width - 1, -1, -1):
            ahead[:, j] = np.where(starts[:, j + 1], j + 1, ahead[:, j + 1])
        for i in range(1, width + 1):
            rows, pieces, lone, lengths = [], [], [], []
            for size in sizes:
                j = i - size
                if j < 0 or size > longest:
                    break
                row = np.flatnonzero(starts[:, i] & starts[:, j] & (best[:, j] > -np.inf))
                if not len(row):
                    continue
                piece = self.probe((sums[row, i] - sums[row, j]) * down[j], size) if size < len(self.keys) else np.full(len(row), -1)
                single = (piece < 0) & (ahead[row, j] == i)  # one character that is no piece
                use = np.flatnonzero((piece >= 0) | single)
                rows.append(row[use])
                pieces.append(piece[use])
                lone.append(single[use])
                lengths.append(np.full(len(use), size))
            if not rows:
                continue
            row, piece, single, size = map(np.concatenate, (rows, pieces, lone, lengths))
            if self.kind == BPE:
                value = np.where(self.compatible(last[row, i - size], piece), size.astype(float), -np.inf)
            else:
                value = best[row, i - size] + np.where(single, worst, self.scores[piece])
            order = np.lexsort((-size, -value, row))  # of each row the maximum, of equal ones the longest
            first = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
            first = first[value[first] > -np.inf]
            best[row[first], i], back[row[first], i], last[row[first], i] = value[first], size[first], piece[first]
        return back, last

    def _words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length: the number of pieces of each, and all pieces one after the other; -1 - b stands for byte b."""
        n, width = words.shape
        back, last = self._advance(words)
        at, out, steps = np.full(n, width), [], 0
        fine = np.ones(n, bool)
        if self.kind == BPE:
            fine = (back[:, width] > 0) & ~((words[:, 0] == 32) & (words[:, min(1, width - 1)] == 32) & (width > 1))
        at[~fine] = 0
        while (at > 0).any():
            row = np.flatnonzero(at > 0)
            size = back[row, at[row]]
            out.append((row, last[row, at[row]], at[row] - size, size))
            at[row] -= size
            steps += 1
        rows, pieces, first, sizes = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        for row in np.flatnonzero(~fine).tolist():
            word, place = words[row].tobytes(), 0
            own, chars = self.merged(word), word.decode("utf-8", "replace")
            for p in own:
                size = len(self.pieces[p]) if p >= 0 else len(chars[len(word[:place].decode("utf-8", "replace"))].encode())
                rows, pieces, first, sizes = np.append(rows, row), np.append(pieces, p), np.append(first, place), np.append(sizes, size)
                place += size
        order = np.lexsort((first, rows))
        rows, pieces, first, sizes = rows[order], pieces[order], first[order], sizes[order]
        if (pieces < 0).any():
            if self.bytes_at < 0:
                pieces = np.where(pieces < 0, self.unknown, pieces)
            else:
                each = np.where(pieces < 0, sizes, 1)
                own = np.repeat(np.arange(len(pieces)), each)
                step = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
                rows = rows[own]
                pieces = np.where(pieces[own] < 0, self.bytes_at + words[rows, np.minimum(first[own] + step, width - 1)], pieces[own])
        return np.bincount(rows, minlength=n), pieces

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's ids begin (one more than texts)."""
        raw = data.tobytes()
        texts = [raw[a:b].replace(MARK, b" ") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        texts = [b" " * self.prefix + t if t else t for t in texts]
        bounds = np.cumsum([0, *map(len, texts)])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        blank = flat == 32
        cut = np.zeros(len(flat) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[bounds] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(flat)) if len(starts) else starts
        try:
            places, first, word = self.known.find_spans(flat, starts, ends)
        except Collision:  # word by word
            own = [self._words(flat[a:b][None, :])[1] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            return np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own]))[np.searchsorted(starts, bounds)]
        new = self.known.new
        a, size = starts[first[new]], (ends - starts)[first[new]]
        order = np.argsort(size, kind="stable")
        counts, lists = np.zeros(len(new), np.int64), [np.zeros(0, np.int64)]
        i = 0
        while i < len(order):
            width = int(size[order[i]])
            j = min(int(np.searchsorted(size[order], width, "right")), i + max(1, CELLS // width))
            own = order[i:j]
            n, pieces = self._words(flat[a[own][:, None] + np.arange(width)])
            counts[own] = n
            lists.append(pieces)
            i = j
        places[new[order]] = self.known.add_spans(order, counts[order], np.concatenate(lists))
        n, ids = self.known.gather(places[word])
        return ids, np.append(0, np.cumsum(n))[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id is no piece's")
        text = b"".join([self.pieces[i] for i in ids.tolist() if self.kinds[i] not in (_CONTROL, _UNUSED)])
        return text[1:] if self.prefix and text[:1] == b" " else text


_models: dict[int, Model] = {}


def _opened(data: bytes) -> Model:
    """A model read once a process, with the pairs it has learnt."""
    if (key := hash(data)) not in _models:
        _models.clear()
        _models[key] = Model.read(data)
    return _models[key]


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: the pieces as little-endian 32-bit integers, n_pieces, decoded: the text again). model: the file's bytes."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file: a megabyte or so
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _opened(shared.value)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in slices(bounds, TEXT_BYTES):
                ids, at = own.encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                lists = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([x.astype("<u4").tobytes() for x in lists], pa.binary()), pa.array([len(x) for x in lists], pa.int64()), pa.array([own.decode(x).decode("utf-8", "replace") for x in lists], pa.string())],
                    [id_col, "ids", "n_pieces", "decoded"],
                )

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {kind.simpleString()}, ids binary, n_pieces long, decoded string")
