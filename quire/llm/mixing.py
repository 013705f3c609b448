"""Mixing with soft membership: documents get rates at which the expected tokens of each domain match given targets.

A classifier learnt from the labelled table gives each document its probabilities of the domains (a linear layer and softmax over the mean
of its words' weights, words hashed to buckets). With n_d tokens, probabilities p_d and rates r_d >= 0 the expected tokens of the domains are
sum(r_d n_d p_d). Starting from rates of 1, projected-gradient steps on the squared distance to the targets are taken over all documents:
each round sums the domains' totals in Spark, and the step r_d <- max(0, r_d - p_d . g) uses one vector g for all, the residual solved
against H = sum(n_d p_d p_d^T). Over all documents, H makes the step length 1 safe. Over those with a positive rate, solved again over those
positive after it, the step is longer where many rates are 0; it is tried first. A document's rate follows from the rounds' vectors alone, so rounds store nothing and the driver
holds one short vector a round.

The classifier takes at most `per_domain` labelled documents of each domain (a bounded sample, dealt by a hash of the id); posteriors,
totals and rates cover all documents.

Defined results: null and empty texts have no tokens, and the bias alone decides their posteriors; labels with null parts are left out; ids
labelled twice count twice; with no labels all documents share each domain evenly; targets beyond reach are approached until even
the safe step no longer helps, and what is left is logged as a warning; an empty table gives an empty one; only id, text and the labels' columns are read, so that others can't clash.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import bound_batches, drop, give_back, stage
from quire.llm.text import word_batches

BUCKETS = 1 << 16
PER_DOMAIN = 3000
#: Rounds at most, the part of the targets that may be left, the part of the squared distance that a quick step must take away not to be
#: solved again, the one below which a round no longer helps, and times that a step is solved again.
MOST_ROUNDS, CLOSE, QUICK, STALLED, RESOLVED = 100, 1e-6, 0.5, 1e-3, 4

_log = logging.getLogger(__name__)


@dataclass
class DomainClassifier:
    """domains, and weights (BUCKETS, domains) and bias."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities of texts given as word buckets, one after the other."""
        n = np.diff(bounds)
        total = np.zeros((len(n), len(self.domains)))
        if len(buckets):
            sums = np.add.reduceat(self.weights[buckets], np.minimum(bounds[:-1], len(buckets) - 1), axis=0)
            total[n > 0] = sums[n > 0] / n[n > 0, None]
        x = total + self.bias
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def train(texts: list[np.ndarray], labels: list[str], domains: list[str], epochs: int = 25, batch: int = 64, rate: float = 0.5, seed: int = 5) -> DomainClassifier:
    """Weights fitted by Adam steps on the rows that a batch touches; all domains weigh the same."""
    y = np.array([domains.index(x) for x in labels], np.int64)
    k, rng = len(domains), np.random.default_rng(seed)
    model = DomainClassifier(domains, np.zeros((BUCKETS, k)), np.zeros(k))
    m, s = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    share = 1 / np.maximum(1, np.bincount(y, minlength=k))[y] if len(y) else np.zeros(0)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            parts = [texts[j] for j in own]
            bounds = np.cumsum([0, *map(len, parts)])
            words = np.concatenate(parts).astype(np.int64)
            p = model.posteriors(words, bounds)
            p[np.arange(len(own)), y[own]] -= 1
            p *= (share[own] / share[own].sum())[:, None]
            step += 1
            model.bias -= 0.05 * p.sum(0)
            if not len(words):
                continue
            used, back = np.unique(words, return_inverse=True)
            each = np.repeat(p / np.maximum(1, np.diff(bounds))[:, None], np.diff(bounds), axis=0)
            g = np.stack([np.bincount(back, each[:, c], len(used)) for c in range(k)], 1) + 1e-7 * model.weights[used]
            m[used] += 0.1 * (g - m[used])
            s[used] += 0.01 * (g * g - s[used])
            model.weights[used] -= rate * m[used] / (np.sqrt(s[used]) + 1e-8)
    return model


def quality_domain(quality: Column, toxic: Column) -> Column:
    """toxic, else low or high; null if a label is null."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, "toxic").when(quality == 0, "low").otherwise("high")


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> DomainClassifier:
    """A classifier from labelled (id, domain), on a bounded sample."""
    known = labelled.where(F.col("domain").isin(domains)).select(F.col(id_col).alias("id"), "domain")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    if not counts:
        return train([], [], domains)
    place = F.pmod(F.xxhash64("id", F.lit(21)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k, v in sorted(counts.items()) for x in (k, min(1.0, per_domain / v))])[F.col("domain")]
    sample = known.where(place < share).orderBy(F.xxhash64("id", F.lit(23)), "id", "domain").limit(2 * per_domain * len(domains))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most 2 * per_domain a domain

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            for ids, hashes, bounds in word_batches(np.arange(len(batch)), batch.column(1), lower=True):
                buckets = (hashes % np.uint64(BUCKETS)).astype("<u2")
                lists = [buckets[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(ids)), batch.column(2).slice(k, len(ids)), pa.array(lists, pa.binary())], ["id", "domain", "words"])
                k += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sorted((r["domain"], str(r["id"]), bytes(r["words"])) for r in texts.select("id", "text", "domain").mapInArrow(words, f"id {kind}, domain string, words binary").collect())
    return train([np.frombuffer(r[2], "<u2") for r in rows], [r[0] for r in rows], domains)


def posteriors(docs: DataFrame, model: DomainClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, p: the domains' probabilities) of all documents."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            for ids, hashes, bounds in word_batches(np.arange(len(batch)), batch.column(1), lower=True):
                p = shared.value.posteriors((hashes % np.uint64(BUCKETS)).astype(np.int64), bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(ids)), pa.array(np.diff(bounds)), pa.array(list(p), pa.list_(pa.float64()))], ["id", "n_tokens", "p"])
                k += len(ids)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, p array<double>")


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with probabilities p after the rounds' steps."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def fit_rates(members: DataFrame, targets: np.ndarray, most_rounds: int = MOST_ROUNDS) -> list[np.ndarray]:
    """The rounds' vectors for members (n_tokens, p): a few passes over the members each."""
    k = len(targets)

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The domains' totals less the targets, and H over the documents with a positive rate."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k)
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)
                r = rates(p, steps)
                out[:k] += p.T @ (n * r)
                out[k:] += (p.T @ (p * (n * (r > 0))[:, None])).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["sums"])

        row = members.select("n_tokens", "p").mapInArrow(run, "sums array<double>").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(k + k * k)]).first()
        sums = np.array([x or 0.0 for x in row])
        return sums[:k] - targets, sums[k:].reshape(k, k)

    def inverse(h: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(h + 1e-12 * max(1.0, float(np.trace(h))) * np.eye(k))

    def distance(x: np.ndarray) -> float:
        return float(x @ safe @ x)

    steps: list[np.ndarray] = []
    residual, active = totals(steps)
    safe, quick = inverse(active), True
    close, left = max(1.0, float(targets.sum())), float(np.abs(residual).sum())
    while left > CLOSE * close and len(steps) < most_rounds:
        before = distance(residual)
        step = inverse(active) @ residual
        tried = [(distance((found := totals([*steps, step]))[0]), step, found)]
        for _ in range(RESOLVED if quick or len(steps) % 8 == 0 else 0):  # Newton's: solved again over the documents that are positive after the step
            if tried[-1][0] <= (1 - QUICK) * before:
                break
            step = step + inverse(found[1]) @ found[0]
            tried.append((distance((found := totals([*steps, step]))[0]), step, found))
        if min(x[0] for x in tried) > (1 - STALLED) * before:
            step = safe @ residual
            tried.append((distance((found := totals([*steps, step]))[0]), step, found))
        after, step, found = min(tried, key=lambda x: x[0])
        if after > (1 - STALLED) * before:
            break
        quick = after <= (1 - QUICK) * before
        steps.append(step)
        residual, active = found
        left = float(np.abs(residual).sum())
    _log.log(logging.WARNING if left > CLOSE * close else logging.INFO, "rates fitted in %d rounds; %.3g of the targets is left", len(steps), left / close)
    return steps


def _fitted(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] | None, keep_totals: Mapping[str, float] | None, id_col: str, text_col: str,
) -> tuple[DataFrame, DomainClassifier, list[np.ndarray]]:
    """The staged posteriors of all documents, the classifier, and the rounds' vectors."""
    wanted = targets if targets is not None else keep_totals
    domains = sorted(wanted)
    bound_batches(docs.sparkSession)
    model = fit_classifier(docs, labelled, domains, id_col, text_col)
    members = stage(posteriors(docs, model, id_col, text_col), "posteriors")
    share = np.array([float(wanted[d]) for d in domains])
    part = F.lit(1.0) if targets is not None else F.element_at(F.array(*[F.lit(float(x)) for x in share]), F.array_position("p", F.array_max("p")).cast("int"))
    total = members.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i] * part).alias(f"s{i}") for i in range(len(domains))]).first()
    total = np.array([x or 0.0 for x in total])
    return members, model, fit_rates(members, total.sum() * share / share.sum() if targets is not None else total)


def rated(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] | None, keep_totals: Mapping[str, float] | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents whose rate in mixed() is `least` or more, with their columns. A row's rate is found once more from its text, so that no text is shuffled."""
    members, model, steps = _fitted(docs, labelled, targets, keep_totals, id_col, text_col)
    drop(members)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        found = [np.zeros(0)]
        for _, hashes, bounds in word_batches(np.arange(len(texts)), pa.array(texts, pa.string(), from_pandas=True), lower=True):
            found.append(rates(shared.value.posteriors((hashes % np.uint64(BUCKETS)).astype(np.int64), bounds), steps))
        give_back()
        return pd.Series(np.round(np.concatenate(found), 9))

    return docs.where(rate(text_col) >= least)


def mixed(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] | None, keep_totals: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_tokens, p_<domain>..., rate, copies) of all documents.

    labelled: (id, domain). targets: the share of all expected tokens that each domain shall have; or keep_totals: the part of the documents most
    probably in each domain whose expected tokens, of all domains, make up the targets (so that certain documents aren't cut for what little they seem
    to hold of another domain). copies rounds the rate up or down by the id's hash, so that copies have the rate as their mean.
    """
    domains = sorted(targets if targets is not None else keep_totals)
    members, _, steps = _fitted(docs, labelled, targets, keep_totals, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(domains))
            rate = np.round(rates(p, steps), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.round(p[:, i], 9)) for i in range(len(domains))], pa.array(rate)], ["id", "n_tokens", *[f"p_{d}" for d in domains], "rate"])

    found = members.mapInArrow(run, f"id {kind}, n_tokens long, " + ", ".join(f"`p_{d}` double" for d in domains) + ", rate double")
    place = F.pmod(F.xxhash64("id", F.lit(22)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return found.withColumn("copies", F.floor(F.col("rate") + place).cast("long")).withColumnRenamed("id", id_col)
