"""Token ids in binary blocks: one array of ids, with the documents' bounds in Elias-Fano code.

A block holds consecutive documents in ascending id order. Bounds and document ids are rising sequences and are stored in Elias-Fano code:
low bits packed, high bits as unary gaps, and 32-bit samples of the places of every 256th one, from which select() finds any bound. That
takes about 2 + log2(tokens / documents) bits a bound instead of 64.

Blocks are written as binary values by Spark's writers, so that any store that Spark reaches will do. Encoding splits texts before
blanks that no whitespace follows and between ASCII letters and other ASCII characters (there the byte-level tokenizer, which is the only kind
taken, always starts a new piece), encodes each distinct piece once a process (as far as
a bounded cache goes, which compares bytes) and puts the results together. New pieces are encoded many in one string, as the same blanks part them.

read_store() takes every document's bounds by select from the samples on; read_documents() finds single documents by their ids, with a
few selects each, and opens only blocks that may hold them.

Defined results: null and empty texts have just the end id; repeated ids stay in a row; null ids sort first and come back as null; an empty
table gives an empty store; texts of any length are encoded whole; only id and text are read, so that other columns can't clash.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.staging import bound_batches, lean, partitions_for
from quire.llm.table import ByteSpanCache, Collision
from quire.llm.text import slices, text_bytes

MAGIC = b"QTOK1\0"
#: Tokens from which a block is closed, ones between two samples, bytes of text encoded at once.
BLOCK_TOKENS, SAMPLE, TEXT_BYTES = 1 << 20, 256, 2 << 20
#: Pieces that are encoded as one string, and shards whose tokens are summed in one place.
JOINED, SUMMED = 4096, 4096
STORED = "shard long, block long, first long, last long, docs long, tokens long, data binary"
#: Stands for a null id in packed arrays.
NO_ID = -(1 << 63)

#: Bytes after a blank at which no text is split: whitespace, and the first bytes of whitespace beyond ASCII.
_UNSAFE = np.zeros(256, bool)
_UNSAFE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER[:128] = ~_LETTER[:128]
_OTHER[0x20] = False


class EliasFano:
    """A rising sequence of n integers from 0 to top."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).reshape(-1), bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence, and the bytes it took."""
        n, low_bits, a, b = struct.unpack_from("<QBII", data)
        at, c = 17, -(-n // SAMPLE)
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c

    def select(self, i: int) -> int:
        """The place of the i-th one in the high bits, from the nearest sample on."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: at % 8] = 0
        while True:
            ones = np.flatnonzero(bits)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left -= len(ones)
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low_bits
        own = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low_bits]
        return (self.select(i) - i) << self.low_bits | sum(int(b) << k for k, b in enumerate(own))

    def selected(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th to the j-th (excluded): select for all of them, each sample's ones together."""
        places = []
        for k in range(i // SAMPLE, -(-j // SAMPLE)):
            first, last = int(self.samples[k]), int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : -(-last // 8)], bitorder="little")) + first // 8 * 8
            places.append(ones[(ones >= first) & (ones < last)])
        places = np.concatenate(places)[i % SAMPLE :][: j - i] if places else np.zeros(0, np.int64)
        high = (places - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bit = i * self.low_bits
        low = np.unpackbits(self.low[bit // 8 : -(-j * self.low_bits // 8)], bitorder="little")[bit % 8 :][: (j - i) * self.low_bits].reshape(j - i, self.low_bits)
        for k in range(self.low_bits):
            high |= low[:, k].astype(np.uint64) << np.uint64(k)
        return high

    def values(self) -> np.ndarray:
        return self.selected(0, self.n)

    def first_at_least(self, value: int) -> int:
        """The place of the first value that isn't smaller."""
        i, j = 0, self.n
        while i < j:
            k = (i + j) // 2
            i, j = (k + 1, j) if self[k] < value else (i, k)
        return i


def write_block(ids: np.ndarray, ends: np.ndarray, tokens: np.ndarray, width: int) -> bytes:
    """Documents ids (rising), where their tokens end, and all tokens."""
    docs = (ids.astype(np.int64) - ids[0]).view(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    head = struct.pack("<6sBxqQ", MAGIC, width, int(ids[0]) if len(ids) else 0, len(tokens))
    return head + EliasFano.encode(ends).to_bytes() + EliasFano.encode(docs).to_bytes() + tokens.astype(f"<u{width}").tobytes()


class Block:
    """A block's bytes, opened: doc ids, ends and tokens."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, width, first, n = struct.unpack_from("<6sBxqQ", view)
        if magic != MAGIC:
            raise ValueError("these bytes aren't a block of tokens")
        self.ends, a = EliasFano.from_bytes(view[24:])
        self._docs, b = EliasFano.from_bytes(view[24 + a :])
        self._first = first
        self.tokens = np.frombuffer(data, f"<u{width}", n, 24 + a + b)

    def __len__(self) -> int:
        return self.ends.n

    def ids(self) -> np.ndarray:
        return (self._docs.values() + np.uint64(self._first & ((1 << 64) - 1))).view(np.int64)

    def document(self, i: int) -> np.ndarray:
        """The tokens of the i-th document, by two selects."""
        return self.tokens[self.ends[i - 1] if i else 0 : self.ends[i]]

    def find(self, doc: int) -> range:
        """The places of the documents with an id."""
        if doc < self._first:
            return range(0)
        return range(self._docs.first_at_least(doc - self._first), self._docs.first_at_least(doc - self._first + 1))


class PieceEncoder:
    """Encodes many texts with a byte-level tokenizer, each distinct piece once."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        how = json.loads(definition)
        if how["normalizer"] or (how["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not how["pre_tokenizer"].get("use_regex", True) or how["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers that split by their usual pattern, without normaliser and prefix, are taken")
        self.known = ByteSpanCache()
        n = self.tokenizer.get_vocab_size()
        self.width = 2 if n <= 1 << 16 else 4
        added = {k: v.content for k, v in self.tokenizer.get_added_tokens_decoder().items()}
        names = {v: k for k, v in self.tokenizer.get_vocab().items()}
        # a byte-level token has a character for each byte
        self.added = [x.encode() for x in added.values()]
        self.lengths = np.array([len(added[k].encode()) if k in added else len(names.get(k, "")) for k in range(max(names, default=-1) + 1)], np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids. Pieces that begin with a blank are joined; if the ids' lengths don't part them again, each is encoded alone."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        (ids,) = self._ids([b"".join(pieces).decode()])
        upto, ends = np.cumsum(self.lengths[ids]), np.cumsum(sizes)
        last = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and (upto[last] == ends).all():
            return np.diff(last + 1, prepend=0), ids
        alone = self._ids([p.decode() for p in pieces])
        return np.fromiter(map(len, alone), np.int64, len(alone)), np.concatenate(alone)

    def encode(self, data: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, `end` after each, and where each text's ids end."""
        at = np.flatnonzero(data[:-1] == 0x20) if len(data) else np.zeros(0, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[at[~_UNSAFE[data[at + 1]]]] = True
        raw = data.tobytes()
        if not any(x in raw for x in self.added):  # these are found before texts are split
            cut[1:-1] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
        cut[bounds[1:]] = False  # a blank that starts the next text is a bound anyway
        cut[bounds] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        try:
            places, first, back = self.known.find_spans(data, starts, ends)
        except Collision:  # texts as they are
            own = self._ids([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
            return np.concatenate([x for ids in own for x in (ids, [end])]), np.cumsum([len(ids) + 1 for ids in own])
        new = self.known.new
        a, b = starts[first[new]], ends[first[new]]
        blank = np.zeros(len(new), bool)
        blank[b - a > 1] = (data[a[b - a > 1]] == 0x20) & ~_UNSAFE[data[a[b - a > 1] + 1]]
        order, sizes, flat = np.argsort(~blank, kind="stable"), [], []
        joined = int(blank.sum())
        pieces = [raw[i:j] for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True)]
        for k in range(0, joined, JOINED):
            n, ids = self._pieces(pieces[k : min(k + JOINED, joined)])
            sizes.append(n)
            flat.append(ids)
        alone = self._ids([p.decode() for p in pieces[joined:]])
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        places[new[order]] = self.known.add_spans(order, np.concatenate(sizes), np.concatenate([*flat, *alone, np.zeros(0, np.int32)]))
        n, tokens = self.known.gather(places[back])
        upto = np.append(0, np.cumsum(n))[np.searchsorted(starts, bounds)]
        return np.insert(tokens, upto[1:], end), upto[1:] + np.arange(1, len(bounds))


_encoders: dict[int, PieceEncoder] = {}


def _encoder(definition: str) -> PieceEncoder:
    """An encoder made once a process, with the pieces it has met."""
    if (key := hash(definition)) not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(definition)
    return _encoders[key]


def write_store(docs: DataFrame, path: str, definition: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> None:
    """Writes documents, in ascending id order, as blocks: rows (shard, block, first and last id, docs, tokens, data) in Parquet files under path. definition: the tokenizer's JSON."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    model = spark.sparkContext.broadcast(definition)  # a vocabulary file: some megabytes
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), *((c, pa.int64()) for c in ("first", "last", "docs", "tokens")), ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n_block, encoder = TaskContext.get().partitionId(), 0, _encoder(model.value)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal n_block, held
            tokens = np.concatenate([t for _, _, t in held])
            before = np.cumsum([0, *[len(t) for _, _, t in held]])
            ids = np.concatenate([i for i, _, _ in held])
            data = write_block(ids, np.concatenate([e + b for (_, e, _), b in zip(held, before, strict=False)]), tokens, encoder.width)
            row = {"shard": shard, "block": n_block, "first": int(ids[0]), "last": int(ids[-1]), "docs": len(ids), "tokens": len(tokens), "data": data}
            n_block, held = n_block + 1, []
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = text_bytes(batch.column(1))
            for i, j in slices(bounds, TEXT_BYTES):
                tokens, ends = encoder.encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], end)
                held.append((ids[i:j], ends, tokens))
                if sum(len(t) for _, _, t in held) >= BLOCK_TOKENS:
                    yield block()
        if held:
            yield block()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    place = F.xxhash64("text")  # so that an id with very many rows can be split
    ranged = rows.repartitionByRange(partitions_for(spark, size, 24 << 20), "id", place).sortWithinPartitions("id", place)
    ranged.mapInArrow(lean(encode), STORED).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each stored document, from the blocks' bytes; start counts the ids of all documents before."""
    blocks = spark.read.schema(STORED).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("n")).withColumn("lot", F.floor(F.col("shard") / F.lit(SUMMED)))
    lots = shards.groupBy("lot").agg(F.sum("n").alias("lot_n")).withColumn("before_lot", F.sum("lot_n").over(Window.orderBy("lot")) - F.col("lot_n"))  # one row for many shards
    shards = shards.withColumn("in_lot", F.sum("n").over(Window.partitionBy("lot").orderBy("shard")) - F.col("n"))
    shards = shards.join(lots, "lot").select("shard", (F.col("in_lot") + F.col("before_lot")).alias("before_shard"))
    own = F.sum("tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("tokens")
    bases = blocks.select("shard", "block", "tokens").withColumn("own", own).join(shards, "shard").select("shard", "block", (F.col("own") + F.col("before_shard")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = Block(batch.column(2)[k].as_py())
                ends = block.ends.selected(0, len(block)).astype(np.int64)
                starts = np.append(0, ends[:-1])
                wide = block.tokens.astype("<u4")
                crc = np.fromiter((zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(ends))
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (block.ids(), np.full(n, batch.column(0)[k].as_py()), np.full(n, batch.column(1)[k].as_py()), starts, ends - starts, crc)],
                    ["id", "shard", "block", "at", "n_tokens", "ids_crc32"],
                )

    docs = blocks.select("shard", "block", "data").mapInArrow(lean(read), "id long, shard long, block long, at long, n_tokens long, ids_crc32 long")
    found = docs.join(bases, ["shard", "block"])
    return found.select(F.when(F.col("id") != F.lit(NO_ID), F.col("id")).alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """(id, tokens) of the stored documents with these ids, a list that the caller holds: each found by select in the blocks whose ids it lies between."""
    wanted = sorted(set(ids))
    near = F.lit(False)
    for i in range(0, len(wanted), max(1, -(-len(wanted) // 64))):  # few conditions that reach the scan
        own = wanted[i : i + max(1, -(-len(wanted) // 64))]
        near = near | ((F.col("last") >= own[0]) & (F.col("first") <= own[-1]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                block = Block(data)
                found = [(doc, block.document(i).tolist()) for doc in wanted if first <= doc <= last for i in block.find(doc)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([t for _, t in found], pa.list_(pa.int64()))], [id_col, "tokens"])

    return spark.read.schema(STORED).parquet(path).where(near).select("first", "last", "data").mapInArrow(read, f"`{id_col}` long, tokens array<long>")
