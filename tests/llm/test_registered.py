"""The registered queries and their SQL, and operators against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quire.llm import jaccard_join, media, ngram_lm, queries, sentencepiece_codec, substring_dedup, token_store
from quire.llm.text import gram_hashes, span_hashes, text_bytes, word_spans

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def thue_morse(log2):
    """Two words of 2**log2 letters that polynomial hashes modulo a power of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(log2):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name, tmp_path):
    queries.queries()[name](spark, TINY).write.parquet(f"{tmp_path}/q")
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TINY}/{table}.parquet'")
    db.execute(f"CREATE TABLE o AS {queries.oracle_sql()[name]}")
    columns = ", ".join(r[0] for r in db.execute("DESCRIBE o").fetchall())
    own, want = f"SELECT {columns} FROM '{tmp_path}/q/*.parquet'", f"SELECT {columns} FROM o"
    assert db.execute(f"SELECT count(*) FROM (({own} EXCEPT ALL {want}) UNION ALL ({want} EXCEPT ALL {own}))").fetchone() == (0,)


def test_mixing_query_meets_its_targets(spark):
    rows = queries.op1_source_mixing(spark, TINY).toPandas()
    shares = np.array([(rows["n_tokens"] * rows["rate"] * rows[f"p_{d}"]).sum() for d in sorted(queries.DOMAIN_SHARES)])
    assert (rows["rate"] >= 0).all() and (abs(rows["copies"] - rows["rate"]) < 1).all()
    assert np.allclose(shares / rows["n_tokens"].sum(), [queries.DOMAIN_SHARES[d] for d in sorted(queries.DOMAIN_SHARES)], atol=1e-5)


def test_media_query_equals_plain_digests(spark, texts):
    for r in queries.op2_media_columns(spark, TINY).collect():
        own = (texts[r.doc_id] or "").encode()
        payload = own + b" " * (-len(own) % 192 if own else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(own), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and f"samples={len(payload) // 192};" in r.feature


def test_media_counts_are_not_trusted():
    """Tables that claim billions of samples, and bytes changed at random, give errors at most."""
    good = media.pack_bytes(media.pad("hello world " * 300))
    at = good.index(b"stsz")
    bad = good[: at + 8] + b"\0\0\0\1\xff\xff\xff\xff" + good[at + 16 :]
    assert media.probe_bytes(bad)["error"] and media.probe_bytes(good)["error"] is None
    rng = np.random.default_rng(1)
    for _ in range(300):
        damaged = bytearray(good)
        for place in rng.integers(0, 600, 4):
            damaged[place] = rng.choice([0, 1, 255])
        media.probe_bytes(bytes(damaged))


def test_fragments():
    box, full = media._box, lambda kind, flags, *v: media._box(kind, np.array([flags, *v], ">u4").tobytes())
    track = box(b"trak", full(b"tkhd", 0, 0, 0, 7, 0), box(b"mdia", full(b"mdhd", 0, 0, 0, 1000, 0, 0)))
    head = box(b"moov", track, box(b"mvex", full(b"trex", 0, 7, 1, 10, 5, 0x10000)))
    moof = lambda first: box(b"moof", box(b"traf", full(b"tfhd", 0x20000, 7), full(b"trun", 0x205, 3, first, 0, 4, 6, 5)))
    whole = head + moof(len(moof(0)) + 8) + box(b"mdat", b"abcdefghijklmno")
    (found,) = media.probe_bytes(whole)["tracks"]
    assert (found["n_samples"], found["duration"], found["media_bytes"]) == (3, 30, 15)
    assert [whole[a:b] for a, b in zip(found["key_starts"], found["key_ends"], strict=True)] == [b"abcd"]


def test_lm_score_equals_plain_mixture(spark, monkeypatch):
    """With given weights, the scores are those of plain dictionaries of counts."""
    weights = np.linspace(0.1, 0.6, ngram_lm.BUCKETS)
    weights = np.stack([weights, 0.9 - weights, np.full(ngram_lm.BUCKETS, 0.1)], 1)
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda *_: weights)
    rows = [(i, " ".join(f"w{(i * k * k) % 7}" for k in range(i % 9))) for i in range(60)] + [(100, None), (101, "unseen words W1")]
    sentences = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), None] for i, t in rows}
    training = [s for i, s in sentences.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for s in training for w in s)
    two = Counter(p for s in training for p in zip(["begin", *s[:-1]], s, strict=True))
    before = Counter(w for s in training for w in ["begin", *s[:-1]])
    total, words = sum(one.values()), len(one)
    for r in ngram_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        want = 0.0
        for a, b in zip(["begin", *sentences[r.doc_id][:-1]], sentences[r.doc_id], strict=True):
            n = before[a] if a == "begin" else one[a]
            w = weights[min(math.frexp(n)[1], ngram_lm.BUCKETS - 1)]
            want += math.log10(w[0] * two[a, b] / max(1, n) + w[1] * one[b] / total + w[2] / (words + 1))
        assert r.score == pytest.approx(want, rel=1e-9)


def test_language_held_out_accuracy(spark):
    rows = queries.op9_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95


def test_no_pattern_of_bytes_collides():
    for log2 in (3, 8, 10, 11):
        a, b = thue_morse(log2)
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        hashes = span_hashes(data, starts, ends)
        assert hashes[0] == hashes[2] != hashes[1]
    values = np.array([1 if x == "a" else 2 for x in "".join(thue_morse(6))], np.uint64)
    for n in (1, 2, 3, 5, 26, 50, 64):
        grams, plain = gram_hashes(values, n), [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
        assert len(set(grams.tolist())) == len(set(plain)) and all((grams[0] == grams[k]) == (plain[0] == plain[k]) for k in range(len(plain)))
    words = [" ".join(thue_morse(11)[k] for _ in range(6)) for k in range(2)]
    data, bounds = text_bytes(pa.array(words))
    starts, ends, at = word_spans(data, bounds)
    ids = jaccard_join.set_ids(*jaccard_join.shingle_sets(span_hashes(data, starts, ends), at, 5))
    assert ids[0] != ids[1]


def test_alike_words_stay_apart(spark):
    """Words that a weak hash takes for one: in the token store, the codec and substring dedup."""
    a, b = thue_morse(11)
    rows = [(0, a), (1, b), (2, " ".join([a] * 60)), (3, " ".join([b] * 60)), (4, "x<|endoftext|>y's 1.\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    encoder = token_store.PieceEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    data, bounds = text_bytes(pa.array([t for _, t in rows]))
    tokens, ends = encoder.encode(data, bounds, 0)
    for (_, text), own in zip(rows, np.split(tokens, ends[:-1]), strict=True):
        assert own.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    assert {r.doc_id: r.decoded for r in sentencepiece_codec.encoded(df, model).collect()} == dict(rows)
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_duplicates(df, texts_too=False).collect()}
    assert removed == dict.fromkeys(range(5), 0)


def test_store_finds_documents_by_id(spark, tmp_path):
    rows = [(i * 3, f"text number {i} " * (i % 4)) for i in range(700)] + [(6, "again")]
    path, definition = f"{tmp_path}/store", open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, definition)
    tokenizer = token_store.PieceEncoder(definition).tokenizer
    want = sorted((i, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for i, t in rows if i in (0, 6, 900, 2097))
    assert sorted((r.doc_id, r.tokens) for r in token_store.read_documents(spark, path, [2097, 0, 6, 900, 7, -5, 10**9]).collect()) == want


def test_elias_fano_selects():
    values = np.cumsum(np.random.default_rng(2).integers(0, 40, 3000))
    code, _ = token_store.EliasFano.from_bytes(memoryview(token_store.EliasFano.encode(values).to_bytes()))
    assert (code.values() == values).all() and (code.selected(250, 1030) == values[250:1030]).all()
    assert [code[k] for k in (0, 255, 256, 2999)] == values[[0, 255, 256, 2999]].tolist()
    assert code.first_at_least(int(values[700])) == np.searchsorted(values, values[700])


def test_parity_bits_rule_out_no_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 64, int(rng.integers(0, 200)), dtype=np.uint64)))
        bits = jaccard_join.parity_bits(np.append(a, b), np.array([0, len(a), len(a) + len(b)]))
        assert jaccard_join.different_bits(bits[:1], bits[1:])[0] <= len(np.setxor1d(a, b))
