"""Language-model scores by deleted interpolation.

The probability of a token after its context is a mix of bigram, unigram and uniform estimates. The mixture weights depend on how often
the context was seen (buckets by powers of two) and are learnt by expectation-maximisation: one fold of the training documents is
left out of the counts, and its tokens are what the weights are fitted to. The final counts take all training documents.

Documents go into chunks, stored once as packed token ids. Each chunk sends its distinct n-grams with their counts to the n-gram's
block; a block adds them up over the corpus and answers each chunk with the totals of the n-grams it asked for. So an n-gram, common or
not, costs one entry for each chunk, and no table of counts is ever broadcast or collected. For EM the tokens' estimates are summed
in a histogram of bounded size.

Tokens: A-Z lower-cased; words `[^\\x20\\x09-\\x0D]+`, then one end. Defined results: null and empty texts are just an end; a null id
counts as the empty text when folds are dealt; repeated rows each count and each get a row; with no training documents all counts are
0 and the uniform estimate remains; an empty table gives an empty one; only id and text are read, so that other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import bound_batches, lean, partitions_for, stage
from quire.llm.text import mix, word_batches

#: Documents are dealt to folds; one is held out of all learning, one of the counts while weights are learnt.
FOLDS, HELD_OUT, TUNED = 7, 2, 0
#: Tokens of a chunk.
CHUNK_TOKENS = 1 << 20
#: Buckets of context counts; 0: not seen.
BUCKETS = 24
#: Bins of the histogram of log estimates: from LEAST_LOG to 0, and one for estimates of 0.
BINS, LEAST_LOG = 64, -24.0
EM_ROUNDS = 100
#: Stand-ins for words at either end of a text.
END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)

_COUNTED, _TUNING, _UNSEEN = range(3)
_CHUNK = "chunk long, kind int, docs binary, lengths binary, tokens binary, words binary"
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("docs", "lengths", "tokens", "words"))])
_ASK = "block int, chunk long, kind int, grams binary, counts binary"
_ASK_ARROW = pa.schema([("block", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_ANSWER = "chunk long, kind int, block int, total binary, rest binary, n long, v long, n_rest long, v_rest long"
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("block", pa.int32()), ("total", pa.binary()), ("rest", pa.binary()), *((c, pa.int64()) for c in ("n", "v", "n_rest", "v_rest"))])


def _planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte of equal weight: what leads is mostly zeros."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents of one kind."""
    first, made = TaskContext.get().partitionId() << 32, 0
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {k: [] for k in range(3)}
    size = dict.fromkeys(held, 0)

    def chunk(kind: int) -> pa.RecordBatch:
        nonlocal made
        docs, lengths, words = map(np.concatenate, zip(*held[kind], strict=True))
        held[kind], size[kind] = [], 0
        vocabulary, tokens = np.unique(words, return_inverse=True)
        made += 1
        row = [first + made, kind, docs.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), tokens.astype("<u4").tobytes(), _planes(vocabulary)]
        return pa.RecordBatch.from_pylist([dict(zip(_CHUNK_ARROW.names, row, strict=True))], _CHUNK_ARROW)

    for batch in batches:
        kinds = batch.column(2).to_numpy(zero_copy_only=False)
        for kind in held:
            own = batch.filter(pa.array(kinds == kind))
            ids = own.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for docs, words, bounds in word_batches(ids, own.column(1), lower=True):
                held[kind].append((docs, np.diff(bounds), words))
                size[kind] += len(words) + len(docs)
                if size[kind] >= CHUNK_TOKENS:
                    yield chunk(kind)
    for kind in held:
        if held[kind]:
            yield chunk(kind)


class _Chunk:
    """A stored chunk's tokens and its distinct n-grams."""

    def __init__(self, row: dict) -> None:
        self.docs, self.kind = np.frombuffer(row["docs"], "<i8"), row["kind"]
        lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        words = _unplanes(row["words"])[np.frombuffer(row["tokens"], "<u4")]
        self.first = np.cumsum(lengths + 1) - (lengths + 1)
        self.tokens = np.full(len(words) + len(lengths), END, np.uint64)
        inside = np.ones(len(self.tokens), bool)
        inside[self.first + lengths] = False
        self.tokens[inside] = words
        context = np.append(BEGIN, self.tokens[:-1])
        context[self.first] = BEGIN
        single = mix(np.append(self.tokens, BEGIN)) & ~np.uint64(1)  # the last bit tells words from pairs
        pair = mix(mix(context) ^ (self.tokens * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
        self.grams, back, self.counts = np.unique(np.append(single, pair), return_inverse=True, return_counts=True)
        n = len(self.tokens)
        self.word, self.pair, begin = back[:n], back[n + 1 :], back[n]
        self.counts[begin] = len(self.docs)
        self.context = np.append(begin, self.word[:-1])
        self.context[self.first] = begin

    def cuts(self, blocks: int) -> np.ndarray:
        """Where the grams of each block begin: blocks are ranges of the grams' first 32 bits."""
        return np.searchsorted((self.grams >> np.uint64(32)).astype(np.int64) * blocks >> 32, np.arange(blocks + 1))


_BEGIN_GRAM = int(mix(np.array([BEGIN]))[0]) & ~1


def _answer(own: list[dict]) -> Iterator[dict]:
    """A block's totals, for each chunk that asked."""
    grams = [_unplanes(r["grams"]) for r in own]
    bounds = np.cumsum([0, *map(len, grams)])
    known, back = np.unique(np.concatenate(grams), return_inverse=True)
    rest, tuning = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    for k, r in enumerate(own):
        if r["kind"] != _UNSEEN:  # a chunk's grams are distinct
            (rest if r["kind"] == _COUNTED else tuning)[back[bounds[k] : bounds[k + 1]]] += np.frombuffer(r["counts"], "<u4")
    total = rest + tuning
    words = (known & np.uint64(1) == 0) & (known != np.uint64(_BEGIN_GRAM))
    yield {"n": int(total[words].sum()), "v": int((total[words] > 0).sum()), "n_rest": int(rest[words].sum()), "v_rest": int((rest[words] > 0).sum())}
    for k, r in enumerate(own):
        at = back[bounds[k] : bounds[k + 1]]
        yield {"chunk": r["chunk"], "kind": r["kind"], "block": r["block"], "total": total[at].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "rest": rest[at].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() if r["kind"] == _TUNING else None}


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def _meet(batches: Iterator[pa.RecordBatch], what: str) -> Iterator[tuple[_Chunk, np.ndarray]]:
    """Chunks and the totals of their grams, from rows of both kinds in any order."""
    chunks: dict[int, dict] = {}
    answers: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["tokens"] is not None:
                chunks[row["chunk"]] = row
            else:
                answers.setdefault(row["chunk"], []).append((row["block"], row[what]))
    for key in sorted(chunks):
        yield _Chunk(chunks.pop(key)), np.concatenate([_numbers(x) for _, x in sorted(answers.pop(key))])


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def _estimates(chunk: _Chunk, totals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its context's bucket, its bigram and its unigram estimate."""
    context = totals[chunk.context]
    return _bucket(context), totals[chunk.pair] / np.maximum(1, context), totals[chunk.word] / max(1, n)


def _bins(p: np.ndarray) -> np.ndarray:
    """0 for an estimate of 0, else 1 and up by its logarithm."""
    with np.errstate(divide="ignore"):
        at = np.clip((np.log(p) - LEAST_LOG) / -LEAST_LOG * BINS, 0, BINS - 1)
    return np.where(p > 0, at.astype(np.int64) + 1, 0)


def learn_weights(cells: np.ndarray, n: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, uniform: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform estimates by EM, from n tokens in each histogram cell and their mean estimates."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = 0, 0.8, 0.2
    bucket = cells // (BINS + 1) ** 2
    p = np.stack([bigram, unigram, np.full(len(n), uniform)], 1)
    for b in np.unique(bucket):
        own, w = bucket == b, np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w * p[own]
            share *= (n[own] / share.sum(1))[:, None]
            w = share.sum(0) / n[own].sum()
        weights[b] = np.maximum(w, [0 if b == 0 else 1e-6, 1e-6, 1e-6])
        weights[b] /= weights[b].sum()
    seen = np.unique(bucket[bucket > 0])
    for b in range(1, BUCKETS):
        if len(seen) and b not in seen:  # the nearest bucket that was
            weights[b] = weights[seen[np.abs(seen - b).argmin()]]
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, tuned: int = TUNED) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10."""
    spark = docs.sparkSession
    bound_batches(spark)
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))
    kind = F.when(fold == held_out, _UNSEEN).when(fold == tuned, _TUNING).otherwise(_COUNTED)
    # null ids are told apart by a flag's stand-in, as ids travel in packed arrays
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"), kind.alias("kind"))
    chunks = stage(texts.mapInArrow(lean(_store), _CHUNK), "chunks")
    size = chunks.select(F.sum(F.octet_length("tokens"))).first()[0] or 0
    blocks = partitions_for(spark, 2.0 * size)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk = _Chunk(row)
                cuts = chunk.cuts(blocks)
                counts = chunk.counts.astype("<u4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": range(blocks), "chunk": [row["chunk"]] * blocks, "kind": [chunk.kind] * blocks,
                        "grams": [_planes(chunk.grams[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
                        "counts": [b"" if chunk.kind == _UNSEEN else counts[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
                    },
                    _ASK_ARROW,
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                rows.setdefault(row["block"], []).append(row)
        for block in sorted(rows):
            yield pa.RecordBatch.from_pylist(list(_answer(rows.pop(block))), _ANSWER_ARROW)

    answers = stage(chunks.mapInArrow(lean(ask), _ASK).repartition(blocks, "block").mapInArrow(lean(answer), _ANSWER), "counts", free=True)
    n, v, n_rest, v_rest = (x or 0 for x in answers.where("chunk is null").agg(*[F.sum(c) for c in ("n", "v", "n_rest", "v_rest")]).first())

    def met(only_tuning: bool) -> DataFrame:
        """Chunks with their answers, one chunk's rows together."""
        left, right, what = chunks, answers.where("chunk is not null"), "total"
        if only_tuning:
            left, right, what = left.where(F.col("kind") == _TUNING), right.where(F.col("kind") == _TUNING), "rest"
        rows = left.unionByName(right.select("chunk", "kind", "block", what), allowMissingColumns=True)
        return rows.repartition(partitions_for(spark, 1.5 * size), "chunk")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rest in _meet(batches, "rest"):
            bucket, p2, p1 = _estimates(chunk, rest, n_rest)
            cell = (bucket * (BINS + 1) + _bins(p2)) * (BINS + 1) + _bins(p1)
            cells, back = np.unique(cell, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells, np.bincount(back), np.bincount(back, p2), np.bincount(back, p1))], ["cell", "n", "p2", "p1"])

    found = met(True).mapInArrow(lean(histogram), "cell long, n long, p2 double, p1 double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "p2", "p1")]).collect()
    found.sort()
    table = np.array([tuple(r) for r in found], float).reshape(-1, 4)
    weights = learn_weights(table[:, 0].astype(np.int64), table[:, 1], table[:, 2] / table[:, 1], table[:, 3] / table[:, 1], 1 / (v_rest + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, totals in _meet(batches, "total"):
            bucket, p2, p1 = _estimates(chunk, totals, n)
            w = weights[bucket]
            seen = totals[chunk.word]
            p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)
            sums = lambda x, first=chunk.first: np.add.reduceat(x, first)
            length = np.diff(np.append(chunk.first, len(seen)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.docs), pa.array(np.full(len(length), chunk.kind == _UNSEEN)), pa.array(length), pa.array(sums((seen > 0).astype(np.int64))),
                    pa.array(np.full(len(length), n)), pa.array(sums(np.log10((seen + 1) / (n + v + 1)))), pa.array(sums(np.log10(p))),
                ],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    scored = met(False).mapInArrow(lean(score), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("id", F.when(F.col("id") != F.lit(-(1 << 63)), F.col("id"))).withColumnRenamed("id", id_col)
