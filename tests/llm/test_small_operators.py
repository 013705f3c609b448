import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import bloom, exact_dedup, media, staging, text, token_store
from quire.llm.components import components
from quire.llm.table import SpanCache, Table

from .conftest import LOWER, words


def test_words_and_hashes():
    column = pa.array(["Aé  b", None, "", "x\ty", " z"])
    data, bounds = text.text_bytes(column)
    starts, ends, at = text.word_spans(data, bounds)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for t in column.to_pylist() for w in words(t, lower=False)]
    assert at.tolist() == [0, 2, 2, 2, 4, 5]
    hashes, _ = text.hashed_words(data, bounds, True)
    assert len(set(hashes.tolist())) == 5
    grams = text.gram_hashes(np.array([1, 2, 3, 1, 2], np.uint64), 2)
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 3


def test_span_hashes_in_blocks():
    data = np.frombuffer(b"ab cd ab " * 1000, np.uint8)
    starts, ends, _ = text.word_spans(data, np.array([0, len(data)]))
    whole, cut = text.span_hashes(data, starts, ends), text.span_hashes(data, starts, ends, block=50)
    assert (whole == cut).all() and len(np.unique(whole)) == 2


def test_tables():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    table = Table(4)
    for part in np.array_split(keys, 7):
        table.put(part, np.arange(len(part), dtype=np.int32))
    want = np.concatenate([np.arange(len(p)) for p in np.array_split(keys, 7)])
    assert (table.get(keys) == want).all() and (table.get(keys + np.uint64(1 << 63)) == -1).all()
    cache = SpanCache(3)
    assert cache.add(np.array([5, 6], np.uint64), np.array([2, 1]), np.array([7, 8, 9])).tolist() == [0, 1]
    assert [x.tolist() for x in cache.gather(np.array([1, 0, 1]))] == [[1, 2, 1], [9, 7, 8, 9]]
    assert cache.find(np.array([5, 7, 8], np.uint64)).tolist() == [-1, -1, -1]


def test_bloom_has_no_false_negatives(spark):
    rows = spark.range(3000).selectExpr("xxhash64(id % 2500) as h").repartition(5)
    filled = bloom.repeated_filter(rows, 3000)
    found = rows.groupBy("h").count().withColumn("m", bloom.maybe_repeated(filled, F.col("h"))).collect()
    assert all(r.m for r in found if r["count"] > 1)
    assert sum(r.m for r in found if r["count"] == 1) < 60


def test_exact_dedup(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    norm = lambda t: (t or "").encode().translate(LOWER)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((i, best[norm(t)], len(groups[norm(t)]), i == best[norm(t)], hashlib.sha256(norm(t)).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_duplicates(docs)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, best.values()))
    assert exact_dedup.exact_duplicates(empty).count() == exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_media_round_trip(docs, empty):
    rows = docs.select("doc_id", "text", media.pack_text("text").alias("m")).withColumn("p", media.probe("m")).collect()
    for r in rows:
        payload = media.pad(r.text)
        assert media.track_bytes(bytes(r.m)) == payload and len(payload) % 192 == 0 and payload.rstrip(b" ") == (r.text or "").encode().rstrip(b" ")
        t = r.p.tracks[0]
        assert (t.codec, t.duration, t.n_samples, r.p.error) == ("raw ", len(payload), len(payload) // 192, None)
        assert all(bytes(r.m)[a:b] == payload[i * 192 * 16 :][:192] for i, (a, b) in enumerate(zip(t.key_starts, t.key_ends, strict=True)))
    assert empty.select(media.pack_text("text")).count() == 0


def test_media_tables_and_damage():
    full = lambda kind, body: struct.pack(">I4sI", 12 + len(body), kind, 0) + body
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    stbl = box(b"stbl", full(b"stsd", struct.pack(">II4s", 1, 8, b"avc1")) + full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 5)) + full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1))
               + full(b"stsz", struct.pack(">IIIIII", 0, 4, 5, 6, 7, 8)) + full(b"co64", struct.pack(">IQQQ", 3, 100, 200, 300)) + full(b"stss", struct.pack(">III", 2, 1, 4)))
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 99)) + box(b"minf", stbl))))
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"1234"
    got = media.probe_bytes(wide + moov)
    assert got["tracks"] == [{"codec": "avc1", "timescale": 1000, "duration": 35, "n_samples": 4, "media_bytes": 26, "first_byte": 100, "key_starts": [100, 300], "key_ends": [105, 308]}]
    assert media.probe_bytes(None)["tracks"] == [] and media.probe_bytes(b"")["error"] is None
    rng = random.Random(5)
    for _ in range(200):
        bad = bytearray(wide + moov)
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        media.probe_bytes(bytes(bad[: rng.randrange(1, len(bad))]))


@pytest.mark.parametrize("values", [[], [0], [0, 0, 5, 5, 9], list(range(0, 100_000, 7)), [3, (1 << 64) - 1]])
def test_elias_fano(values):
    ef, size = token_store.EliasFano.from_bytes(memoryview(token_store.EliasFano.encode(np.array(values, np.uint64)).to_bytes()))
    assert ef.values().tolist() == values and size
    assert [ef[i] for i in range(0, len(values), max(1, len(values) // 300))] == values[:: max(1, len(values) // 300)]
    with pytest.raises(IndexError):
        ef[len(values)]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(2).integers(1, 1000, 10_000))
    assert len(token_store.EliasFano.encode(ends).to_bytes()) * 8 / len(ends) < 13


def test_token_store(spark, docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, definition = Tokenizer.from_file(path), open(path).read()
    where = staging.new_path(spark, "test")
    token_store.write_store(docs, where, definition)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, where).collect())
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect())
    start = 0
    for (known, i, t), g in zip(rows, got, strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert g == (start, i if known else None, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    block = token_store.Block(bytes(spark.read.parquet(where).orderBy("shard", "block").first()["data"]))
    assert len(block.document(0)) == block.ends[0] and len(block.ids()) == len(block)
    where = staging.new_path(spark, "test")
    token_store.write_store(empty, where, definition)
    assert token_store.read_store(spark, where).count() == 0


def test_split_encoding_equals_whole():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder, rng = Tokenizer.from_file(path), token_store.PieceEncoder(open(path).read()), random.Random(9)
    parts = ["a", "Word", " ", "  ", "\n", "\t", "'s", "é", "　", " ", "12", "!?", "<|endoftext|>", "\r\n", "日本", "🙂", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    tokens, ends = encoder.encode(*text.text_bytes(pa.array(texts)), 0)
    for t, a, b in zip(texts, np.append(0, ends[:-1]), ends, strict=True):
        assert tokens[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2050)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
