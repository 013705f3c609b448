"""A corpus pipeline of five stages, each on all that the one before kept.

Language ID drops texts without any language and those whose best language is hardly likelier than others, and fills in unknown languages; exact dedup keeps the document with the largest id of equal texts; the n-gram Jaccard join
keeps the least id of each group of near duplicates; mixing drops documents whose fitted rate rounds to 0, with targets that are the expected
tokens of the documents most probably of high or low quality, without those most probably toxic; SentencePiece encodes what is left, and decodes it again.

Empty tables pass through; null texts go in the first stage; columns beside those of documents stay until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, jaccard_join, language_id, mixing, staging
from quire.llm.queries import encoded_digest, labelled_domains

#: A text's language must be so many times as likely as if all were alike.
LIKELIER = 1.5
#: Parts of the domains' documents whose expected tokens the mix keeps.
KEPT = {"high": 1.0, "low": 1.0, "toxic": 0.0}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: null texts, texts without letters and those that the network can't place go; a null lang becomes the predicted one."""
    model = language_id.fit(docs)
    mark = "__lang"
    least = min(0.5, LIKELIER / len(model.labels)) if model else 0.0
    found = docs.withColumn(mark, language_id.predicted(model, "text")).where((F.col(f"{mark}.lang") != language_id.UNKNOWN) & (F.col(f"{mark}.score") >= least))
    return found.withColumn("lang", F.coalesce("lang", f"{mark}.lang")).drop(mark)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.drop_near_duplicates(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rate is nearer to 1 than to 0."""
    return mixing.rated(docs, labelled_domains(spark, sf_dir), None, keep_totals=KEPT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and the digests of these and of the texts decoded from them."""
    return encoded_digest(docs, ids_too=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_domains),
    ("sentencepiece", encode),
]

#: Trained models and tokenizers are beyond SQL; the stages' operators are tested against SQL or plain versions, the stages for what they keep.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written and read again. What a stage leaves behind on its way, and what the one before it kept, goes once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, spent = staging.result(partial(stage, spark, docs, sf_dir), name), before
        if spent is not None:
            staging.drop(spent)
        before = docs
    return docs
