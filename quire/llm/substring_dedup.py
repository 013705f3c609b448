"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Spans of at least `window` words that a smaller document has as well are duplicates. A block can't hold the whole corpus, so blocks are cut
by content: the windows of a document are dealt by their anchor, the `anchor`-word gram of least hash in the window (equal windows have
equal anchors). A block is the index of all runs of windows with its anchors, and the reference of each run is what smaller documents have
there. A run is parsed greedily: from the first window that the reference has, at the place in the least document with it, the factor grows
word by word for as long as that one source goes on alike, and ends there or at the block's edge. Then the boundary is checked: the parse
goes on at the very next window, most of whose words the factor has covered, so that no window across two factors is missed. Factors of one
document, source and distance that touch or overlap are one factor, also across blocks (`factors`). The source is the least document at the
factor's start, not the one with the longest match. The words covered are those of the definition, whatever the sources (`duplicate_spans`).

What is shuffled: one row of packed arrays for each chunk of texts and block, about 7 bytes a word; words are compared by the hashes of
their windows, so that the texts themselves stay. Runs of windows that a chunk holds more than once are sent once, with their smallest
document; the others are factored on the spot, so that many copies or a common passage cost a row for each chunk. An anchor with a large
share of all runs (`hot_share`; at most 1/hot_share of them, which bounds what is broadcast) has its windows dealt by their own hashes
instead, so that no task gets them all; factors there begin as single windows.

Defined results: null and empty texts have no words; ids must tell texts apart: repeated rows of one id and text count as one document
and all get its result; documents with a null id are kept whole and are no source for others; an empty table gives an empty one; only
id and text are read, so that other columns can't clash. Windows are told apart by 64 + 40 hash bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.staging import bound_batches, lean, partitions_for, stage
from quire.llm.text import gram_hashes, mix, text_bytes, word_batches, word_spans

#: Words of a window and of its anchor.
WINDOW, ANCHOR = 50, 26
#: Words of a chunk, within which runs are told apart before they are sent.
CHUNK_WORDS = 1 << 20
#: Share of all runs from which an anchor counts as hot.
HOT_SHARE = 1 / 20_000
#: Runs of an anchor in a chunk from which it is reported as maybe hot.
REPORTED = 8
#: Bytes of a window's hash that are sent beside its anchor's.
SENT = 5

_BLOCK = "block int, docs binary, anchors binary, firsts binary, counts binary, at binary, windows binary, hot binary, factors binary"
_BLOCK_ARROW = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("docs", "anchors", "firsts", "counts", "at", "windows", "hot", "factors"))])
_HOT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4")])
_FACTOR = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4"), ("source", "<i8"), ("at", "<u4")])


def _runs(hashes: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window, number of windows, words from the first window to the anchor, anchor hash; and all window hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[:n] == text[window - 1 :]
    grams = gram_hashes(hashes, anchor)
    reach = window - anchor + 1
    where = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, reach)[:n].argmin(axis=1)
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (where[1:] != where[:-1]) | (text[1:n] != text[: n - 1])
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(whole & np.append(first[1:] | ~whole[1:], True)) + 1
    return text[starts], starts, ends - starts, where[starts] - starts, grams[where[starts]], gram_hashes(hashes, window)


def _chunks(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk: docs, word positions in the doc, counts, firsts, anchors of the runs, and their windows' hashes one after the other."""
    parts: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        known = batch.column(0).is_valid()
        batch = batch.filter(known)
        for ids, hashes, bounds in word_batches(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), lower=False):
            text, starts, counts, firsts, anchors, windows = _runs(hashes, bounds, window, anchor)
            if len(text):
                take = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                parts.append((ids[text].astype(np.int64), starts - bounds[text], counts, firsts, anchors, windows[take]))
            size += len(hashes)
            if size >= CHUNK_WORDS and parts:
                yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                parts, size = [], 0
    if parts:
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _factors(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, sources: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Factors of these columns."""
    out = np.zeros(len(docs), _FACTOR)
    for name, value in zip(_FACTOR.names, (docs, starts, ends, sources, at), strict=True):
        out[name] = value
    return out


def _joined(factors: np.ndarray, one_source: bool) -> np.ndarray:
    """Factors, with those of a document that touch or overlap made one; only those of one source and distance, or else whatever the source, which then says nothing."""
    if not len(factors):
        return factors
    starts, ends = factors["start"].astype(np.int64), factors["end"].astype(np.int64)
    keys = [factors["doc"], *[factors["source"], starts - factors["at"]] * one_source]
    order = np.lexsort((starts, *keys[::-1]))
    new = np.append(True, np.zeros(len(order) - 1, bool))
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    far = (np.cumsum(new) - 1) * (1 << 33)  # a running maximum that starts anew with each group
    reached = np.maximum.accumulate(ends[order] + far) - far
    cut = new
    cut[1:] |= starts[order[1:]] > reached[:-1]
    at = np.flatnonzero(cut)
    out = factors[order[at]]
    out["end"] = reached[np.append(at[1:], len(order)) - 1]
    return out


def _earliest(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The index: for each place, the first place of its key in the smallest document."""
    order = np.lexsort((docs, keys))
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _parsed(docs: np.ndarray, at: np.ndarray, counts: np.ndarray, firsts: np.ndarray, anchors: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """The greedy factors of runs that share a block, all runs advancing together; each turn takes every open factor one window on, or ends it."""
    upto = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(owner)) - np.repeat(upto - counts, counts)
    keys = mix(anchors[owner] ^ mix(windows + (firsts[owner] - step).astype(np.uint64) * np.uint64(1 << 56)))
    index = _earliest(keys, docs[owner])
    n = len(keys)
    # the next window, from each on, that the reference has
    found = np.append(np.where(docs[owner[index]] < docs[owner], np.arange(n), n), n)
    found = np.minimum.accumulate(found[::-1])[::-1]
    x, last = found[upto - counts], upto
    x, last = x[x < last], last[x < last]
    begin, y, out = x, index[x], []
    while len(x):
        goes_on = (x + 1 < last) & (y + 1 < upto[owner[y]])
        goes_on[goes_on] = keys[x[goes_on] + 1] == keys[y[goes_on] + 1]
        ended = ~goes_on
        first, end = begin[ended], x[ended]
        origin = y[ended] - (end - first)
        out.append(_factors(docs[owner[first]], at[owner[first]] + step[first], at[owner[end]] + step[end] + window, docs[owner[origin]], at[owner[origin]] + step[origin]))
        # past the boundary: the next window, which the factor covers but for its last word
        x = np.where(goes_on, x + 1, found[x + 1])
        open_ = x < last
        begin, y = np.where(goes_on, begin, x)[open_], np.where(goes_on, y + 1, index[np.minimum(x, n - 1)])[open_]
        x, last = x[open_], last[open_]
    return np.concatenate(out) if out else np.zeros(0, _FACTOR)


def _single_factors(single: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows dealt by their own hashes have a source, and their factors."""
    index = _earliest(single["key"], single["doc"])
    over = single["doc"][index] < single["doc"]
    own, source = single[over], single[index[over]]
    return over, _factors(own["doc"], own["at"], own["at"].astype(np.int64) + window, source["doc"], source["at"])


def _parse(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int, hot_share: float, one_source: bool) -> DataFrame:
    """The factors found in each block (id, start, end, source, source_start), joined by _joined within the block."""
    bound_batches(docs.sparkSession)
    spark, texts = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, words = 0, 0
        for chunk in _chunks(batches, window, anchor):
            runs, words = runs + len(chunk[0]), words + len(chunk[5])
            values, counts = np.unique(chunk[4], return_counts=True)
            some = counts >= REPORTED
            yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some].astype(np.int64)), pa.nulls(int(some.sum()), pa.int64())], ["anchor", "runs", "words"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([runs], pa.int64()), pa.array([words], pa.int64())], ["anchor", "runs", "words"])

    counted = stage(texts.mapInArrow(lean(count), "anchor long, runs long, words long").groupBy("anchor").agg(F.sum("runs").alias("runs"), F.sum("words").alias("words")), "anchors")
    total = counted.where("anchor is null").first()
    n_runs, n_words = (total["runs"], total["words"]) if total else (0, 0)
    least = max(1000, int(n_runs * hot_share))
    hot = np.array([r[0] for r in counted.where((F.col("anchor").isNotNull()) & (F.col("runs") >= least)).select("anchor").collect()], np.int64).view(np.uint64)  # at most 1 / hot_share
    hot.sort()
    blocks = partitions_for(spark, 7.0 * n_words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, at, counts, firsts, anchors, windows in _chunks(batches, window, anchor):
            ends = np.cumsum(counts)
            sums = np.append(np.uint64(0), np.cumsum(mix(windows)))
            whole = mix(anchors ^ mix((sums[ends] - sums[ends - counts]) + firsts.astype(np.uint64) * np.uint64(64) + counts.astype(np.uint64)))
            index = _earliest(whole, ids)
            known = ids[index] < ids
            factors = _factors(ids[known], at[known], at[known] + counts[known] + window - 1, ids[index[known]], at[index[known]])
            sent = np.flatnonzero(~known)
            is_hot = np.zeros(len(sent), bool)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, anchors[sent]), len(hot) - 1)
                is_hot = hot[place] == anchors[sent]
            cold, warm = sent[~is_hot], sent[is_hot]
            block = (anchors[cold] % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cold, block = cold[order], block[order]
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            take = np.repeat(ends[cold] - counts[cold] - (np.cumsum(counts[cold]) - counts[cold]), counts[cold]) + np.arange(counts[cold].sum())
            packed = windows[take].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
            upto = np.append(0, np.cumsum(counts[cold]))
            warm_take = np.repeat(ends[warm] - counts[warm] - (np.cumsum(counts[warm]) - counts[warm]), counts[warm]) + np.arange(counts[warm].sum())
            own = np.repeat(warm, counts[warm])
            step = np.arange(len(own)) - np.repeat(np.cumsum(counts[warm]) - counts[warm], counts[warm])
            single = np.zeros(len(own), _HOT)
            single["key"] = mix(anchors[own] ^ mix(windows[warm_take] + (firsts[own] - step).astype(np.uint64)))
            single["doc"], single["at"] = ids[own], at[own] + step
            # a common window is sent once for each chunk; its larger documents are covered
            over, more = _single_factors(single, window)
            factors = _joined(np.concatenate([factors, more]), one_source)
            single = single[~over]
            single = single[np.argsort(single["key"] % np.uint64(blocks), kind="stable")]
            warm_cuts = np.searchsorted((single["key"] % np.uint64(blocks)).astype(np.int64), np.arange(blocks + 1))
            factor_cuts = np.arange(blocks + 1) * len(factors) // blocks
            rows: dict[str, list] = {name: [] for name in _BLOCK_ARROW.names}
            for b in range(blocks):
                i, j = cuts[b], cuts[b + 1]
                mine, more = single[warm_cuts[b] : warm_cuts[b + 1]], factors[factor_cuts[b] : factor_cuts[b + 1]]
                if i == j and not len(mine) and not len(more):
                    continue
                c = cold[i:j]
                for name, value in zip(rows, (b, ids[c].astype("<i8"), anchors[c].astype("<u8"), firsts[c].astype(np.uint8), counts[c].astype(np.uint8), at[c].astype("<u4"), packed[upto[i] : upto[j]], mine, more), strict=True):
                    rows[name].append(value if name == "block" else value.tobytes())
            yield pa.RecordBatch.from_pydict(rows, _BLOCK_ARROW)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                rows.setdefault(row["block"], []).append(row)
        for block in sorted(rows):
            own = rows.pop(block)
            read = lambda name, kind, own=own: np.frombuffer(b"".join(r[name] for r in own), kind)
            anchors, counts = read("anchors", "<u8"), read("counts", np.uint8).astype(np.int64)
            _, back, often = np.unique(anchors, return_inverse=True, return_counts=True)
            keep = often[back] > 1  # an anchor that occurs once has no second document
            windows = np.zeros((int(counts[keep].sum()), 8), np.uint8)
            windows[:, :SENT] = read("windows", np.uint8).reshape(-1, SENT)[np.repeat(keep, counts)]
            parsed = _parsed(read("docs", "<i8")[keep], read("at", "<u4")[keep].astype(np.int64), counts[keep], read("firsts", np.uint8)[keep].astype(np.int64), anchors[keep], windows.view("<u8").reshape(-1), window)
            factors = _joined(np.concatenate([parsed, _single_factors(read("hot", _HOT), window)[1], read("factors", _FACTOR)]), one_source)
            yield pa.RecordBatch.from_arrays([pa.array(factors[c].astype(np.int64)) for c in _FACTOR.names], ["id", "start", "end", "source", "source_start"])

    return texts.mapInArrow(lean(send), _BLOCK).repartition(blocks, "block").mapInArrow(lean(factor), "id long, start long, end long, source long, source_start long")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot_share: float = HOT_SHARE) -> DataFrame:
    """The factors of at least `window` words: id, start, end (excluded), source (a smaller id) and source_start, with equal words there. Factors of one id may overlap."""
    found = _parse(docs, id_col, text_col, window, anchor, hot_share, True).withColumn("distance", F.expr("start - source_start"))
    line = Window.partitionBy("id", "source", "distance").orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("id", "source", "distance", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "start", "end", "source", F.expr("start - distance").alias("source_start"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot_share: float = HOT_SHARE) -> DataFrame:
    """Spans of words (id, start, end; end excluded) that factors cover, whatever their sources: all windows that a document with a smaller id has as well. Spans of one id may overlap."""
    return _parse(docs, id_col, text_col, window, anchor, hot_share, False).select("id", "start", "end")


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 16) -> Iterator[bytes]:
    """The words, one blank between them, some at a time."""
    for i in range(0, len(starts), at_once):
        a, b = starts[i : i + at_once], ends[i : i + at_once]
        length = b - a + 1
        out = np.cumsum(length) - length
        index = np.arange(int(length.sum())) + np.repeat(a - out, length)
        index[out + length - 1] = 0
        block = data[index]
        block[out + length - 1] = 32
        yield (block if i + at_once < len(starts) else block[:-1]).tobytes()


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, texts_too: bool = True) -> DataFrame:
    """For each document: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words, one blank between)."""
    spans = stage(duplicate_spans(docs, id_col, text_col, window, anchor), "spans", free=True)
    lists = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[("kept_text", pa.string())] * texts_too])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            rows = []
            for k, (i, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = data[bounds[k] : bounds[k + 1]]
                starts, ends, _ = word_spans(own, np.array([0, len(own)]))
                n = len(starts)
                if found:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, [min(s["start"], n) for s in found], 1)
                    np.add.at(change, [min(s["end"], n) for s in found], -1)
                    keep = np.cumsum(change[:-1]) == 0
                    starts, ends = starts[keep], ends[keep]
                sha, parts = hashlib.sha256(), []
                for part in joined_words(own, starts, ends):
                    sha.update(part)
                    if texts_too:
                        parts.append(part)
                rows.append((i, n, n - len(starts), sha.hexdigest(), *[b"".join(parts).decode("utf-8", "replace")] * texts_too))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in schema.names}, schema)

    joined = texts.join(lists, "id", "left").select("id", "text", "spans")
    return joined.mapInArrow(lean(cut), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts_too).withColumnRenamed("id", id_col)
