"""N-gram Jaccard self-join by vertical partitioning, down to groups of linked documents.

Documents are sets of distinct word shingles; equal sets are one class, and everything after works on classes. All shingles have one global
order: those that many documents share (counted in every chunk of texts; a list of bounded size) come last, by their counts, all others by
their hashes. Two sets that reach the similarity share a shingle among the first of each in that order (its prefix), so classes that share a
prefix shingle are candidates, as far as their lengths and the shingle's places leave enough to share. The order is cut into fragments, and
each class's set with it. A fragment counts the partial overlaps of the candidate pairs separately, the counts are summed by pair, and the sum
decides exactly.

Groups of near copies would give all their pairs. Links are wanted only up to connection, so candidates come in rounds. First each prefix
shingle's list pairs its members with the one that has the fewest rarer shingles before it: what copies share comes last in the order, so
that one is nearest to the text that they were made from. After that only pairs across components are looked at, within the lists and in
order of length, so that few are met which lengths and places rule out; where these are still many, lists are paired with another member
first. All pairs that remain are counted, so no link between components is lost.

What is shuffled: packed prefix shingles (a fifth of all), of which those that only one class has go no further; for each pair the parity bits
of both classes, which rule out most that aren't linked; for each of the others the set of one class, and for each 256 pairs of a representative
its own; partial counts. Lists of common shingles are rows of their own and never meet in
one task; long lists meet in blocks.

Defined results: null and empty texts and texts without words have empty sets and are linked with nothing; texts with fewer words than a
shingle have their whole sequence as one shingle; repeated rows are linked; rows with a null id are members like others, and a group's id is
the least known one (null if none is known); an empty table gives an empty one; only id and text are read, so that other columns can't clash.
Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bloom
from quire.llm.components import components
from quire.llm.staging import bound_batches, drop, lean, partitions_for, result, stage
from quire.llm.text import gram_hashes, mix, word_batches

#: Words of a shingle; links need 100 * overlap >= PERCENT * union.
SHINGLE, PERCENT = 5, 80
#: Words of a chunk, its count from which a shingle is reported as common, and how many of these come last in the order.
CHUNK_WORDS, REPORTED, COMMON = 1 << 19, 2, 1 << 18
#: Fragments of the order: of the shingles in order of hash, and of the common ones in order of count.
PLAIN_FRAGMENTS, COMMON_FRAGMENTS = 12, 4
#: Rounds in which lists are paired with one member before all pairs that are left are counted; so many a row are few enough to be counted at once.
STAR_ROUNDS, FEW_PAIRS = 5, 2
#: Pairs of a representative that are counted in one place, members of a list that meet in one block, and pairs looked at in one go.
TOGETHER, LIST_BLOCK, AT_ONCE = 256, 8192, 1 << 20
#: Bytes of a class's parity bits, at least and at most; in segments they take the place of a fragment of this number.
LEAST_BITS, MOST_BITS, PARITY = 32, 512, -1

_PREFIX = np.dtype([("token", "<u8"), ("sid", "<i8"), ("n", "<u4"), ("at", "<u4")])


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of texts given as word hashes, sorted within each text, and their bounds."""
    words = np.diff(bounds)
    text = np.repeat(np.arange(len(words)), words)
    grams = gram_hashes(hashes, n)
    inside = text[: len(grams)] == text[n - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((words > 0) & (words < n))
    whole = [mix(gram_hashes(hashes[bounds[k] : bounds[k + 1]], int(words[k])) + np.uint64(words[k])) for k in short.tolist()]
    owner = np.concatenate([text[: len(grams)][inside], short])
    values = np.concatenate([grams[inside], *whole]) if len(owner) else np.zeros(0, np.uint64)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])) if len(owner) else np.zeros(0, bool)
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(words) + 1))


def set_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit ids of sets, equal for equal sets."""
    sums = np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(0x94D049BB133111EB))))
    sizes = np.diff(bounds).astype(np.uint64)
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(sizes)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, set ids, shingles, bounds) of a few texts at a time."""
    for batch in batches:
        k = 0
        for rows, hashes, at in word_batches(np.arange(len(batch)), batch.column(1), lower=True):
            values, bounds = shingle_sets(hashes, at, n)
            yield batch.column(0).slice(k, len(rows)), set_ids(values, bounds), values, bounds
            k += len(rows)


class _Distinct:
    """Passes each set id once a task, as far as a bounded memory goes."""

    def __init__(self, most: int = 1 << 16) -> None:
        self.seen, self.most = set(), most

    def __call__(self, sids: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen = set()
        return np.array([not (s in self.seen or self.seen.add(s)) for s in sids.tolist()], bool)


def _taken(values: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets that are kept."""
    sizes = np.diff(bounds)
    return values[np.repeat(keep, sizes)], np.cumsum([0, *sizes[keep]])


def parity_bits(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set: bits that its shingles flip, each one bit; about four bits a shingle, a power of two of bytes.

    Sets that differ in d shingles differ in d bits at most, so that bits can rule out a pair, and never one that is linked.
    """
    sizes, out = np.diff(bounds), []
    for size, a, b in zip(sizes.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        width = min(max(LEAST_BITS, 1 << max(0, (size - 1) // 2).bit_length()), MOST_BITS)
        place = (values[a:b] >> np.uint64(64 - 13)).astype(np.int64) & (8 * width - 1)  # shorter bits are the longer ones, folded
        out.append(np.packbits(np.bincount(place, minlength=8 * width).astype(np.uint8) & 1, bitorder="little").tobytes())
    return out


def different_bits(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many parity bits of two sets differ, pair by pair; the longer are folded."""
    wide, out = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2), np.zeros(len(a), np.int64)
    for x, y in np.unique(wide, axis=0):
        own = np.flatnonzero((wide == (x, y)).all(1))
        width = min(x, y)
        sides = [np.bitwise_xor.reduce(np.frombuffer(b"".join([side[k] for k in own.tolist()]), np.uint8).reshape(len(own), -1, width), axis=1) for side in (a, b)]
        out[own] = np.bitwise_count(sides[0] ^ sides[1]).sum(1)
    return out


class _Order:
    """The global order: common shingles (sorted by hash, with ranks) come after all others."""

    def __init__(self, common: np.ndarray, ranks: np.ndarray) -> None:
        self.common, self.ranks = common, ranks

    def rank(self, values: np.ndarray) -> np.ndarray:
        """-1, or the place among the common ones."""
        if not len(self.common):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.common, values), len(self.common) - 1)
        return np.where(self.common[at] == values, self.ranks[at], -1)

    def fragment(self, values: np.ndarray) -> np.ndarray:
        rank = self.rank(values)
        plain = ((values >> np.uint64(32)).astype(np.int64) * PLAIN_FRAGMENTS) >> 32
        return np.where(rank < 0, plain, PLAIN_FRAGMENTS + rank * COMMON_FRAGMENTS // max(1, len(self.common)))


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _last_partner(n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The largest set that a class with n shingles can link with, if the first shingle they share is its at-th: from there on the least overlap must be left."""
    return np.minimum((100 + percent) * (n - at) // percent - n, 100 * n // percent)


def _ranges(group: np.ndarray, n: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of group and n: the first and last row (excluded) after each that its last partner's length allows."""
    place = group * (1 << 32) + n
    end = np.searchsorted(place, group * (1 << 32) + np.minimum(last, (1 << 32) - 1), "right")
    start = np.arange(len(n)) + 1
    return start, np.maximum(start, end)


def _in_ranges(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (row, each row of its range), some at a time."""
    upto, i = np.cumsum(end - start), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, "right")))
        size = end[i:j] - start[i:j]
        row = np.repeat(np.arange(i, j), size)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]
        i = j


def _hopeful(rows: np.ndarray, percent: int) -> np.ndarray:
    """Of the rows of lists: those of which a partner in the same list has a fitting length."""
    _, group = np.unique(rows["token"], return_inverse=True)
    n, last = rows["n"].astype(np.int64), _last_partner(rows["n"].astype(np.int64), rows["at"].astype(np.int64), percent)
    by = np.lexsort((n, group))
    start, end = _ranges(group[by], n[by], last[by])
    found = np.zeros(len(rows), bool)
    for x, y in _in_ranges(start, end):
        fits = last[by[y]] >= n[by[x]]
        found[by[x[fits]]] = found[by[y[fits]]] = True
    return found


def _read(texts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, sid) of all documents, and (token, count) of common shingles."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, fresh = [], 0, _Distinct()

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= REPORTED
            none = pa.nulls(int(some.sum()))
            return pa.RecordBatch.from_arrays([none.cast(ids.type), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(tokens[some].view(np.int64)), pa.array(counts[some])], names)

        names = ["id", "n_shingles", "sid", "token", "count"]
        for ids, sids, values, bounds in _sets(batches, n):
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(sids), none, none], names)
            held.append(_taken(values, bounds, fresh(sids))[0])
            size += len(held[-1])
            if size >= CHUNK_WORDS:
                yield report()
                held, size = [], 0
        if held:
            yield report()

    found = stage(texts.mapInArrow(lean(run), f"id {kind}, n_shingles long, sid long, token long, count long"), "members")
    return found.where("sid is not null").select("id", "n_shingles", "sid"), found.where("token is not null").groupBy("token").agg(F.sum("count").alias("count"))


def _lists(texts: DataFrame, order: Broadcast, n: int, percent: int, n_shingles: int) -> DataFrame:
    """(token, sid, n, at): classes under the prefix shingles that more than one class has; at: its place in the class's order."""
    blocks = partitions_for(texts.sparkSession, 5.0 * n_shingles)
    names, schema = ["block", "plain", "common"], "block int, plain binary, common binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held, size = _Distinct(), [], 0

        def chunk() -> pa.RecordBatch:
            rows = np.concatenate([r for r, _ in held])
            common = np.concatenate([c for _, c in held])
            plain = rows[~common]
            block = (plain["token"] % np.uint64(blocks)).astype(np.int64)
            by_block = np.argsort(block, kind="stable")
            plain, cuts = plain[by_block], np.searchsorted(block[by_block], np.arange(blocks + 1))
            rest, parts = rows[common], np.arange(blocks + 1) * int(common.sum()) // blocks  # known to be shared: these need not meet
            some = np.flatnonzero(np.diff(cuts) + np.diff(parts))  # so that there are never more rows than entries, however many blocks there are
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array([x[at[k] : at[k + 1]].tobytes() for k in some.tolist()], pa.binary()) for x, at in ((plain, cuts), (rest, parts))]], names)

        for _, sids, values, bounds in _sets(batches, n):
            keep = fresh(sids)
            sids = sids[keep]
            values, bounds = _taken(values, bounds, keep)
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rank = order.value.rank(values)
            by_rank = np.lexsort((rank, owner))  # stable: plain ones stay in order of hash
            at = np.arange(len(values)) - np.repeat(bounds[:-1], sizes)
            use = at <= np.repeat(sizes - _least_overlap(sizes, percent), sizes)
            place = by_rank[use]
            rows = np.zeros(len(place), _PREFIX)
            rows["token"], rows["sid"], rows["n"], rows["at"] = values[place], sids[owner[use]], sizes[owner[use]], at[use]
            held.append((rows, rank[place] >= 0))
            size += len(rows)
            if size >= CHUNK_WORDS // 2:
                yield chunk()
                held, size = [], 0
        if held:
            yield chunk()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, own, common in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                plain.setdefault(block, []).append(own)
                if common:
                    yield out(np.frombuffer(common, _PREFIX), True)
        for block in sorted(plain):
            rows = np.frombuffer(b"".join(plain.pop(block)), _PREFIX)
            by = np.lexsort((rows["sid"], rows["token"]))
            token, sid = rows["token"][by], rows["sid"][by]
            new = np.append(True, token[1:] != token[:-1]) if len(by) else np.zeros(0, bool)
            other = np.append(False, (token[1:] == token[:-1]) & (sid[1:] != sid[:-1])) if len(by) else new
            lists = np.cumsum(new) - 1
            shared = np.bincount(lists, other, int(new.sum())) > 0  # lists with a second class
            rows = rows[by[(new | other) & shared[lists]]]  # one row of each class
            yield out(rows[_hopeful(rows, percent)], False)

    def out(rows: np.ndarray, common: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(rows[c].astype(np.int64)) for c in _PREFIX.names], pa.array(np.full(len(rows), common))], [*_PREFIX.names, "common"])

    rows = stage(texts.mapInArrow(lean(send), schema).repartition(blocks, "block").mapInArrow(lean(meet), "token long, sid long, n long, at long, common boolean"), "prefixes", free=True)
    own = rows.where("common").drop("common").distinct()
    lists = stage(rows.where("not common").drop("common").unionByName(own), "lists")
    drop(rows)
    return lists


def _segments(texts: DataFrame, members: DataFrame, lists: DataFrame, order: Broadcast, n: int) -> DataFrame:
    """(sid, fragment, shingles) of the classes on lists: read again from one document of each, some from more than one."""
    key = F.xxhash64("id")
    listed = lists.select("sid").distinct()
    chosen = stage(members.groupBy("sid").agg(F.min("id").alias("id")).join(listed, "sid", "left_semi").select(key.alias("key")), "chosen")
    wanted = bloom.repeated_filter(chosen.unionAll(chosen), chosen.count())  # each key twice, so that the filter knows them all

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(bloom.tested(wanted.value, batch.column(0).to_numpy())))
            for _, sids, values_of, bounds in _sets(iter([kept]), n):
                values, owner = values_of, np.repeat(np.arange(len(sids)), np.diff(bounds))
                fragment = order.value.fragment(values)
                by = np.lexsort((fragment, owner))  # stable: shingles stay in order
                owner, fragment, values = owner[by], fragment[by], values[by]
                starts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1]))) if len(owner) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(owner))
                parts = [values[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                bits = parity_bits(values_of, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(sids[owner[starts]], sids)), pa.array(np.append(fragment[starts], np.full(len(sids), PARITY)).astype(np.int32)), pa.array(parts + bits, pa.binary())], ["sid", "fragment", "shingles"])

    found = stage(texts.select(key.alias("key"), "text").mapInArrow(lean(cut), "sid long, fragment int, shingles binary"), "segments")
    drop(chosen)
    return found


def _near(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that parity bits don't rule out."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = different_bits(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield batch.select([0, 1, 2, 3]).filter(pa.array((both - apart) * (100 + percent) >= 2 * percent * both))

    named = lambda x: bits.select(F.col("sid").alias(x), F.col("bits").alias(f"bits_{x}"))
    met = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    return met.mapInArrow(lean(test), "a long, b long, na long, nb long")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int, size: float) -> DataFrame:
    """Of the pairs (a, b, na, nb) those that reach the similarity, as (a, b): partial overlaps by fragment, summed by pair.

    A fragment of b's set goes where a's fragment is; a class with many pairs has its own in as many places as it has lots of TOGETHER pairs.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(TOGETHER)).alias("lots"))
    dealt = stage(pairs.join(lots, "a").withColumn("lot", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")).select("a", "lot", "b", "na", "nb"), "dealt")
    left = dealt.select("a", "lot").distinct()
    rows = segments.join(dealt, segments["sid"] == dealt["b"]).select("a", "lot", "fragment", "b", "na", "nb", "shingles")
    rows = rows.unionByName(segments.join(left, segments["sid"] == left["a"]).select("a", "lot", "fragment", "shingles"), allowMissingColumns=True)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The overlaps of one fragment of one lot: rows with b, and at least one without it, which holds a's shingles."""
        b = batch.column(3)
        own, rest = batch.filter(b.is_null()), batch.filter(b.is_valid())
        if not len(own) or not len(rest):
            return rest.slice(0, 0).select([0, 3, 4, 5]).append_column("overlap", pa.array([], pa.int64()))
        _, first = np.unique(rest.column(3).to_numpy(), return_index=True)
        rest = rest.take(pa.array(first))
        known, parts = np.frombuffer(own.column(6)[0].as_py(), "<u8"), rest.column(6).to_pylist()
        values = np.frombuffer(b"".join(parts), "<u8")
        hit = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
        upto = np.append(0, np.cumsum(hit))
        ends = np.cumsum([len(x) // 8 for x in parts])
        overlap = upto[ends] - upto[np.append(0, ends[:-1])]
        return rest.select([0, 3, 4, 5]).append_column("overlap", pa.array(overlap)).filter(pa.array(overlap > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:  # in order of a, lot and fragment
            if held is not None:
                batch = pa.concat_batches([held, batch])
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            bounds = [0, *cuts.tolist()]
            found = [counted(batch.slice(i, j - i)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            if found:
                yield pa.concat_batches(found)
            held = batch.slice(bounds[-1])
        if held is not None and len(held):
            yield counted(held)

    spark = pairs.sparkSession
    met = rows.select("a", "lot", "fragment", "b", "na", "nb", "shingles").repartition(partitions_for(spark, size), "a", "lot", "fragment").sortWithinPartitions("a", "lot", "fragment")
    partial = met.mapInArrow(lean(count), "a long, b long, na long, nb long, overlap long")
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    links = stage(total.where(F.col("overlap") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "links", free=True)
    drop(dealt)
    return links


def _possible(percent: int, x: str, y: str):
    """Lengths that can reach the similarity, and enough shingles from the shared one on. x, y: prefixes of the columns n and at."""
    nx, ny, ax, ay = (F.col(f"{p}{c}") for c in ("n", "at") for p in (x, y))
    lengths = (F.lit(100) * nx >= percent * ny) & (F.lit(100) * ny >= percent * nx)
    return lengths & (F.lit(100 + percent) * F.least(nx - ax, ny - ay) >= percent * (nx + ny))


def _star_pairs(left: DataFrame, open_lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb) of each open list's representative a with its other members, across components."""
    first = F.xxhash64("sid", "token", F.lit(turn)) if turn else F.floor(F.col("at") * F.lit(1 << 20) / F.col("n"))
    reps = left.join(open_lists.select("token"), "token", "left_semi").groupBy("token").agg(F.min(F.struct(first.alias("first"), F.xxhash64("sid").alias("tie"), "sid", "n", "at", "comp")).alias("rep"))
    reps = stage(reps.select("token", *[F.col(f"rep.{c}").alias(f"x_{c}") for c in ("sid", "n", "at", "comp")]), "reps")
    met = left.select("token", *[F.col(c).alias(f"y_{c}") for c in ("sid", "n", "at", "comp")]).join(reps, "token").where("x_comp <> y_comp").where(_possible(percent, "x_", "y_"))
    turned = F.col("x_sid") > F.col("y_sid")
    pair = met.groupBy(F.least("x_sid", "y_sid").alias("lo"), F.greatest("x_sid", "y_sid").alias("hi")).agg(
        F.min(F.when(turned, F.col("y_n")).otherwise(F.col("x_n"))).alias("n_lo"), F.min(F.when(turned, F.col("x_n")).otherwise(F.col("y_n"))).alias("n_hi"), F.min(turned).alias("turned")
    )
    pick = lambda c, d: F.when(F.col("turned"), F.col(d)).otherwise(F.col(c))
    pairs = stage(pair.select(pick("lo", "hi").alias("a"), pick("hi", "lo").alias("b"), pick("n_lo", "n_hi").alias("na"), pick("n_hi", "n_lo").alias("nb")), "pairs")
    drop(reps)
    return pairs


def _cross_pairs(left: DataFrame, open_lists: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """All pairs (a, b, na, nb) across components that lists leave possible, not distinct, and their number."""
    blocks = F.ceil(F.col("size") / F.lit(LIST_BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    rows = left.join(open_lists.select("token", blocks.alias("blocks")), "token").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = stage(rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "n", "at", "comp"), "met")

    def pairs(batches: Iterator[pa.RecordBatch], count: bool) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]) for batch in batches]
        token, i, j, own, sid, n, at, comp = np.concatenate(parts, 1) if parts else np.zeros((8, 0), np.int64)
        last = _last_partner(n, at, percent)
        by = np.lexsort((n, j, i, token))
        token, i, j, own, sid, n, comp, last = (x[by] for x in (token, i, j, own, sid, n, comp, last))
        new = np.append(True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(by) else np.zeros(0, bool)
        start, end = _ranges(np.cumsum(new), n, last)
        total = 0
        for x, y in _in_ranges(start, end):
            fits = (comp[x] != comp[y]) & (last[y] >= n[x]) & ((i[x] == j[x]) | (own[x] != own[y]))
            x, y = x[fits], y[fits]
            total += len(x)
            if not count:
                x, y = np.where(sid[x] < sid[y], x, y), np.where(sid[x] < sid[y], y, x)
                known = np.unique(np.stack([sid[x], sid[y], n[x], n[y]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in known], ["a", "b", "na", "nb"])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["pairs"])

    dealt = rows.repartition(partitions_for(left.sparkSession, 64.0 * rows.count()), "token", "i", "j")
    total = dealt.mapInArrow(lean(lambda x: pairs(x, True)), "pairs long").agg(F.sum("pairs")).first()[0] or 0
    return dealt.mapInArrow(lean(lambda x: pairs(x, False)), "a long, b long, na long, nb long"), total


def class_links(texts: DataFrame, members: DataFrame, common: DataFrame, n: int, percent: int) -> DataFrame | None:
    """Links (a, b) that connect all classes which similarity connects; None if there are none."""
    spark = texts.sparkSession
    top = sorted((r["count"], r["token"]) for r in common.orderBy(F.desc("count"), "token").limit(COMMON).collect())
    tokens = np.array([t for _, t in top], np.int64).view(np.uint64)
    by_hash = np.argsort(tokens)
    order = spark.sparkContext.broadcast(_Order(tokens[by_hash], by_hash))  # at most COMMON entries
    n_shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    lists = _lists(texts, order, n, percent, n_shingles)
    if lists.isEmpty():
        return None
    segments = _segments(texts, members, lists, order, n)
    bits = stage(segments.where(F.col("fragment") == PARITY).groupBy("sid").agg(F.min("shingles").alias("bits")), "bits")
    segments = segments.where(F.col("fragment") != PARITY)
    links: list[DataFrame] = []
    asked: list[DataFrame] = []
    left = lists.withColumn("comp", F.col("sid"))
    for turn in range(STAR_ROUNDS + 1):
        if turn and links:
            labels = stage(components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "sid"), "labels")
            left = stage(lists.join(labels, "sid", "left").select("token", "sid", "n", "at", F.coalesce("component", "sid").alias("comp")), "listed")
        sizes = left.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        open_lists = stage(sizes.where("lo <> hi").select("token", "size"), "open")
        rows = open_lists.agg(F.sum("size")).first()[0]
        if not rows:
            break
        last = turn == STAR_ROUNDS
        if turn or last:
            found, total = _cross_pairs(left, open_lists, percent)
            last = last or total <= FEW_PAIRS * rows
        pairs = stage(found.distinct(), "pairs", free=True) if last else _star_pairs(left, open_lists, percent, turn)
        for known in asked:  # counted before
            same = (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi"))
            pairs = pairs.join(known.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), same, "left_anti")
        pairs = stage(_near(pairs, bits, percent), "near")
        size = 8.0 * (pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0)
        if size:
            new = _linked(pairs, segments, percent, size)
            asked.append(pairs)
            if not new.isEmpty():
                links.append(new)
        if last:
            break
    return reduce(DataFrame.unionByName, links) if links else None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach)."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, common = _read(texts, shingle)
    alone = members.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    classes = members.where("n_shingles > 0").groupBy("sid").agg(F.min("id").alias("least"))
    links = class_links(texts, members.where("n_shingles > 0"), common, shingle, percent)
    if links is not None:
        labels = stage(components(links).withColumnRenamed("node", "sid"), "labels")
        tied = stage(classes.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid")), "tied")
        least = stage(tied.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        classes = tied.join(least, "component").select("sid", "component_id")
    else:
        classes = classes.withColumnRenamed("least", "component_id")
    # both sides come straight from files, so that adaptive execution can split the partition of a class with many copies
    found = members.where("n_shingles > 0").join(stage(classes, "classes"), "sid").select("id", "n_shingles", "component_id")
    return alone.unionByName(found).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with the least id of their group, with their columns. Only texts that may have to go are shuffled; of the files on the way only the ids that go stay."""

    def leaving() -> DataFrame:
        return near_duplicates(docs, id_col, text_col, shingle, percent).where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone"))

    gone = result(leaving, "gone")
    keys = gone.select(F.xxhash64("__gone"))
    wanted = bloom.repeated_filter(keys.unionAll(keys), gone.count())
    mark = "__maybe"
    tested = docs.withColumn(mark, bloom.maybe_repeated(wanted, F.xxhash64(F.col(id_col))))
    stays = tested.where(mark).join(gone, F.col(id_col).eqNullSafe(F.col("__gone")), "left_anti")
    return tested.where(~F.col(mark)).unionByName(stays).drop(mark)
