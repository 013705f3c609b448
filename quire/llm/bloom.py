"""A sliced Bloom filter of the keys that may occur more than once, built from partial filters.

Each bit has a twin: `once` says that a key hit it, `twice` that a second hit came. Partial filters merge in any order
(twice = twice_a | twice_b | once_a & once_b), so each task sends only the bits its own keys set. A key that occurs twice has all
its bits in `twice`; one that occurs once has them there only by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import mix

#: Bits of a slice; a key's bits all lie in one slice.
SLICE_BITS = 1 << 20
#: Bits set by a key.
PROBES = 4
#: Bits of the filter for each key, while the filter is under its bound.
BITS_A_KEY = 16
#: Most bits of the whole filter (32 MB). Beyond about 17 million keys false positives grow; they cost shuffling, never correctness.
MOST_BITS = 1 << 28
#: Keys a task gathers before it sends its partial filter.
KEYS_AT_ONCE = 1 << 18

_PARTIAL = "slice int, once binary, twice binary"


def slices_for(n: int) -> int:
    """Slices of the filter for n keys: a power of two, within the bound."""
    bits = 1 << (max(1, n) * BITS_A_KEY - 1).bit_length()
    return min(max(bits, SLICE_BITS), MOST_BITS) // SLICE_BITS


def _positions(keys: np.ndarray, n_slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice of each key, and its bits in it as a (keys, PROBES) array."""
    a, b = mix(keys), mix(keys ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (a >> np.uint64(40)).astype(np.int64) & (n_slices - 1), ((a[:, None] + steps * b[:, None]) >> np.uint64(8)).astype(np.int64) & (SLICE_BITS - 1)


def _partial(keys: np.ndarray, n_slices: int) -> Iterator[dict]:
    at, bits = _positions(keys, n_slices)
    order = np.argsort(at, kind="stable")
    at, bits = at[order], bits[order]
    for s in np.unique(at):
        found, counts = np.unique(bits[np.searchsorted(at, s) : np.searchsorted(at, s, "right")], return_counts=True)
        yield {"slice": int(s), "once": found.astype("<u4").tobytes(), "twice": found[counts > 1].astype("<u4").tobytes()}


def repeated_filter(hashes: DataFrame, n: int) -> Broadcast:
    """The filter over hashes' only column (long, no nulls), of which there are about n."""
    n_slices = slices_for(n)
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            kept.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, kept)) >= KEYS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(list(_partial(np.concatenate(kept), n_slices)), schema)
                kept = []
        if kept:
            yield pa.RecordBatch.from_pylist(list(_partial(np.concatenate(kept), n_slices)), schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = masks.setdefault(row["slice"], (np.zeros(SLICE_BITS, bool), np.zeros(SLICE_BITS, bool)))
                bits = np.frombuffer(row["once"], "<u4")
                twice[bits[once[bits]]] = True
                twice[np.frombuffer(row["twice"], "<u4")] = True
                once[bits] = True
        for s, (_, twice) in masks.items():
            yield pa.RecordBatch.from_pylist([{"slice": s, "once": b"", "twice": np.packbits(twice, bitorder="little").tobytes()}], schema)

    spark = hashes.sparkSession
    parts = hashes.mapInArrow(build, _PARTIAL).repartition(min(n_slices, 64), "slice").mapInArrow(merge, _PARTIAL)
    filled = np.zeros((n_slices, SLICE_BITS // 8), np.uint8)
    for row in parts.collect():  # at most MOST_BITS in all
        filled[row["slice"]] = np.frombuffer(row["twice"], np.uint8)
    return spark.sparkContext.broadcast(filled)


def tested(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter holds."""
    at, bits = _positions(keys.astype(np.int64).view(np.uint64), len(bitmap))
    return ((bitmap[at[:, None], bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def maybe_repeated(filled: Broadcast, key: Column) -> Column:
    """True for every key that occurs twice, and for a few that don't."""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(tested(filled.value, keys.to_numpy(np.int64)))

    return test(key)
