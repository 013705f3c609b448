"""Differences of texts and of documents, block by block."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarity from which blocks are versions of each other, and from which they count as unchanged (fixed values).
ALIKE, SAME = 0.4, 0.99
#: Sizes beyond which coarser ways take over (fixed values): characters of two texts, block pairs, word pairs.
MOST_CHARS, MOST_BLOCKS, MOST_WORDS = 10_000, 10_000_000, 25_000_000


def _bigram_distance(a: str, b: str) -> int:
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    total = x.total() + y.total()
    return int(np.floor(max(len(a), len(b)) * (1 - (2 * (x & y).total() / total if total else 1)) + 0.5))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a row of the table at a time; an estimate from shared bigrams for very long texts."""
    if len(a) + len(b) > MOST_CHARS:
        return _bigram_distance(a, b)
    if not a or not b:
        return len(a) + len(b)
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    places = np.arange(len(y) + 1)
    row = places.copy()
    for i, char in enumerate(x.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (y != char), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places  # insertions run along the row
    return int(row[-1])


def squeezed(text: str | None) -> str:
    return " ".join((text or "").split())


def text_similarity(a: str | None, b: str | None) -> float:
    """1 - distance / longer length of the squeezed texts."""
    a, b = squeezed(a), squeezed(b)
    return 1.0 if a == b else 0.0 if not a or not b else 1 - edit_distance(a, b) / max(len(a), len(b))


def _common(n: int, m: int, same: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence where `same` holds; ties go back in the first sequence."""
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        hit = np.where(same[i], best[i, :-1] + 1, 0)
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(hit, best[i, 1:]))
    pairs, i, j = [], n, m
    while i and j:
        if same[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def word_diff(a: str | None, b: str | None) -> list[dict]:
    """Runs of equal, deleted and inserted words and white space."""
    x, y = (re.split(r"(\s+)", t or "") for t in (a, b))
    if len(x) * len(y) <= MOST_WORDS:
        kinds = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
        u, v = (np.array([kinds[w] for w in t]) for t in (x, y))
        pairs = _common(len(x), len(y), u[:, None] == v[None, :])
    else:
        places: dict[str, list[int]] = {}
        for k in range(len(y) - 1, -1, -1):
            places.setdefault(y[k], []).append(k)
        pairs, at = [], 0
        for i, w in enumerate(x):
            own = places.get(w, [])
            while own and own[-1] < at:
                own.pop()
            if own:
                pairs.append((i, own.pop()))
                at = pairs[-1][1] + 1
    steps: list[tuple[str, str]] = []
    i = j = 0
    for p, q in [*pairs, (len(x), len(y))]:
        steps += [("delete", w) for w in x[i:p]] + [("insert", w) for w in y[j:q]]
        steps += [("equal", x[p])] if p < len(x) and q < len(y) else []
        i, j = p + 1, q + 1
    out: list[dict] = []
    for kind, text in steps:
        if out and out[-1]["type"] == kind:
            out[-1]["text"] += text
        else:
            out.append({"type": kind, "text": text})
    return [s for s in out if s["text"]]


def diffed_words(a: str | Column, b: str | Column) -> Column:
    """word_diff() of two columns."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([word_diff(p, q) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, "array<struct<type:string,text:string>>")(a, b)


def align(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[int | None, int | None, float | None]]:
    """Blocks (type, text) of two versions, put side by side: a longest sequence of alike pairs, what is left in between alone."""
    n, m = len(a), len(b)
    if n * m > MOST_BLOCKS:
        pairs = [(i, i) for i in range(min(n, m))]
        score = {p: text_similarity(a[p[0]][1], b[p[1]][1]) if a[p[0]][0] == b[p[1]][0] else 0.0 for p in pairs}
    else:
        x, y = [squeezed(t) for _, t in a], [squeezed(t) for _, t in b]
        sim = np.zeros((n, m))
        for i in range(n):
            for j in range(m):
                longer = max(len(x[i]), len(y[j]))
                if a[i][0] == b[j][0] and not (longer and abs(len(x[i]) - len(y[j])) / longer > 1 - ALIKE):
                    sim[i, j] = text_similarity(x[i], y[j])
        pairs = _common(n, m, sim >= ALIKE)
        score = {p: float(sim[p]) for p in pairs}
    out, i, j = [], 0, 0
    for p, q in [*pairs, (n, m)]:
        out += [(k, None, None) for k in range(i, p)] + [(None, k, None) for k in range(j, q)]
        out += [(p, q, score[p, q])] if (p, q) in score else []
        i, j = p + 1, q + 1
    return out


DIFF = "pair_id long, seq int, type string, before_block int, after_block int, similarity double"


def diff_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two sets of blocks (pair_id, block_id, type, text), pair by pair."""
    columns = ["pair_id", "block_id", "type", "text"]

    def fold(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = (t.reindex(columns=columns).sort_values("block_id") for t in (x, y))  # a side without blocks has no columns
        rows = []
        for k, (i, j, s) in enumerate(align(*[list(zip(t["type"], t["text"], strict=True)) for t in (x, y)])):
            kind = "removed" if j is None else "added" if i is None else "unchanged" if s >= SAME else "modified"
            pair = (x if len(x) else y)["pair_id"].iloc[0]
            rows.append((pair, k, kind, None if i is None else x["block_id"].iloc[i], None if j is None else y["block_id"].iloc[j], 1.0 if kind == "unchanged" else s))
        return pd.DataFrame(rows, columns=["pair_id", "seq", "type", "before_block", "after_block", "similarity"]).astype({"before_block": "Int32", "after_block": "Int32"})

    return before.select(*columns).groupBy("pair_id").cogroup(after.select(*columns).groupBy("pair_id")).applyInPandas(fold, DIFF)


def diff_stats(diff: DataFrame) -> DataFrame:
    """(pair_id, added, removed, modified, unchanged)."""
    return diff.groupBy("pair_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("added", "removed", "modified", "unchanged")])
