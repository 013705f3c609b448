"""Language ID with a byte convolutional network, trained in numpy on labelled text.

Texts are read as UTF-8 in windows of fixed length. Filters of several widths slide over a window's bytes; each filter's greatest
response in the window goes through a linear layer and softmax. On one-hot bytes a filter is a table of weights by position and byte,
so that applying it means looking up and adding rows. A text's score is the mean of its windows' probabilities, by bytes.

Training takes at most `per_label` documents of each label and `most` in all (a bounded sample, dealt by a hash of the id), one window of
each; everything else runs over whole texts.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the label that comes first; rows repeated
give results repeated; null labels are left out, with no labelled text every text is `und`; an empty table gives an empty one; detect() keeps all columns and replaces those named like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import bound_batches, give_back
from quire.llm.text import LOWER

#: Bytes of a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Windows that go through the network at once.
AT_ONCE = 128
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """labels, and weights: filter tables by width (width, 256, FILTERS), the pooled features' bias, the linear layer and its bias."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    linear: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray, where: list | None = None) -> np.ndarray:
        """Each filter's greatest response in windows x (n, WINDOW); where: gets the positions of these."""
        out = []
        for table in self.tables:
            n = x.shape[1] - len(table) + 1
            total = table[0][x[:, :n]]
            for j in range(1, len(table)):
                total += table[j][x[:, j : n + j]]
            if where is None:
                out.append(total.max(axis=1))
            else:
                where.append(total.argmax(axis=1))
                out.append(np.take_along_axis(total, where[-1][:, None], 1)[:, 0])
        return np.concatenate(out, 1) + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(self.pooled(x), 0) @ self.linear + self.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (zeros fill the last one of each), the text of each, and its bytes."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts.tolist(), strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    size = np.full(len(owner), WINDOW, np.int64)
    last = np.cumsum(counts) - 1
    size[last] = np.maximum(1, [len(t) - (c - 1) * WINDOW for t, c in zip(texts, counts.tolist(), strict=True)])
    return LOWER[flat].reshape(-1, WINDOW), owner, size


def _groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def score(model: ByteCNN, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text."""
    out = np.zeros((len(texts), len(model.labels)))
    for i, j in _groups(texts):
        x, owner, size = windows(texts[i:j])
        p = np.concatenate([model.probabilities(x[k : k + AT_ONCE]) for k in range(0, len(x), AT_ONCE)]) * size[:, None]
        total = np.add.reduceat(p, np.searchsorted(owner, np.arange(j - i)), axis=0)
        out[i:j] = total / total.sum(axis=1, keepdims=True)
    return out


def train(texts: list[bytes], targets: list[str], epochs: int = 14, rate: float = 0.02, seed: int = 7) -> ByteCNN:
    """A network fitted with Adam to one window of each text; in every epoch most windows are cut to a random length, so that short texts are learnt as well."""
    labels = sorted(set(targets))
    y = np.searchsorted(labels, targets)
    rng = np.random.default_rng(seed)
    n_features = len(WIDTHS) * FILTERS
    model = ByteCNN(
        labels, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(n_features, np.float32),
        rng.normal(0, 0.3, (n_features, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32),
    )
    for table in model.tables:
        table[:, 0] = 0
    weights = [*model.tables, model.bias, model.linear, model.offset]
    moments, squares, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    data = windows([t[:WINDOW] for t in texts])[0] if texts else np.zeros((0, WINDOW), np.uint8)
    length = np.array([min(len(t), WINDOW) for t in texts])
    share = 1 / np.maximum(1, np.bincount(y, minlength=len(labels)))[y]
    for _ in range(epochs):
        order = rng.permutation(len(data))
        cut = np.where(rng.random(len(data)) < 0.6, np.maximum(8, length * rng.random(len(data)) ** 1.5), length)
        for i in range(0, len(data), AT_ONCE):
            own = order[i : i + AT_ONCE]
            x = np.where(np.arange(WINDOW) < cut[own, None], data[own], 0)
            where: list[np.ndarray] = []
            features = model.pooled(x, where)
            active = np.maximum(features, 0)
            p = _softmax(active @ model.linear + model.offset)
            p[np.arange(len(own)), y[own]] -= 1
            p *= (share[own] / share[own].sum())[:, None].astype(np.float32)
            back = (p @ model.linear.T) * (features > 0)
            gradients = []
            for k, w in enumerate(WIDTHS):
                own_back, g = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros((w, 256, FILTERS), np.float32)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, where[k] + j, 1), np.arange(FILTERS)[None, :]), own_back)
                g[:, 0] = 0
                gradients.append(g)
            gradients += [back.sum(0), active.T @ p + 1e-4 * model.linear, p.sum(0)]
            step += 1
            for w, g, m, s in zip(weights, gradients, moments, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 1500, most: int = 20_000) -> ByteCNN | None:
    """A network for the labels of docs, from a bounded sample; None if no text is labelled."""
    bound_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where(
        "label is not null and text is not null"
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None
    each = max(1, min(per_label, most // len(counts)))
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k, v in sorted(counts.items()) for x in (k, min(1.0, each / v))])[F.col("label")]
    n = F.length("text")
    start = F.lit(1) + F.pmod(F.xxhash64("id", F.lit(12)), F.greatest(n - F.lit(WINDOW), F.lit(0)) + F.lit(1)).cast("int")
    rows = known.where(place < share).select("id", "label", F.substring(F.col("text"), start, F.lit(WINDOW)).alias("piece")).orderBy(F.xxhash64("id", F.lit(13)), "piece").limit(2 * most).collect()
    rows = sorted(((r["label"], str(r["id"]), r["piece"]) for r in rows if any(map(str.isalpha, r["piece"]))))
    return train([r[2].encode() for r in rows], [r[0] for r in rows]) if rows else None


def predicted(model: ByteCNN | None, text: str | Column) -> Column:
    """The struct (lang, score) of whole texts."""
    text = F.col(text) if isinstance(text, str) else text
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing

    @F.pandas_udf("lang string, score double")
    def run(column: pd.Series) -> pd.DataFrame:
        p = score(model, [x.encode() if x else b"" for x in column])
        give_back()
        best = p.argmax(axis=1)
        return pd.DataFrame({"lang": np.array(model.labels, object)[best], "score": np.clip(p[np.arange(len(p)), best], 0, 1)})

    once = run.asNondeterministic()  # else a filter on the result would run it a second time
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), once(text)).otherwise(nothing)


def detect(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its probability."""
    mark = "__predicted"
    return docs.withColumn(mark, predicted(model, text_col)).withColumn(lang_col, F.col(f"{mark}.lang")).withColumn(score_col, F.col(f"{mark}.score")).drop(mark)
