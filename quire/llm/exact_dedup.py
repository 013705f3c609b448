"""Exact duplicates by two passes over a Bloom filter: only rows whose hash may repeat are shuffled.

The first pass builds the filter of hashes that may occur twice (see bloom), the second tests each row with it. Rows that fail the
test are unique and pass straight through; the rest are grouped by their SHA-256, so false positives cost only shuffling.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal texts the row with
the largest id stays; repeated rows with one id form a group like any other, and all rows with the largest id are marked kept, of
which drop_exact_duplicates() leaves one; a null id never wins unless the whole group has none; an empty table gives an empty one;
columns beside id and text are neither read nor can they clash.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import bloom
from quire.llm.staging import drop, stage


def normal_text(text: Column) -> Column:
    """Null as empty, A-Z lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def _filter(digests: DataFrame) -> Broadcast:
    return bloom.repeated_filter(digests.select(F.xxhash64("text_sha256")), digests.count())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    digests = stage(docs.select(F.col(id_col).alias("id"), F.sha2(normal_text(F.col(text_col)), 256).alias("text_sha256")), "digests")
    repeated = bloom.maybe_repeated(_filter(digests), F.xxhash64("text_sha256"))
    tested = digests.withColumn("repeated", repeated)
    alone = tested.where(~F.col("repeated")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    maybe = tested.where("repeated").drop("repeated")
    groups = stage(maybe.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    # both sides come straight from files, so that adaptive execution can split the partition of a hot group
    found = maybe.join(groups, "text_sha256").select("id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(found).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns. Only texts that may repeat are shuffled."""
    sha = F.sha2(normal_text(docs[text_col]), 256)
    key, mark = "__sha", "__repeated"
    digests = stage(docs.select(docs[id_col].alias("id"), sha.alias("text_sha256")), "digests")
    filled = _filter(digests)
    tested = docs.withColumn(key, sha).withColumn(mark, bloom.maybe_repeated(filled, F.xxhash64(key)))
    keepers = stage(
        digests.where(bloom.maybe_repeated(filled, F.xxhash64("text_sha256"))).groupBy("text_sha256").agg(F.max("id").alias("__keep")),
        "keepers",
    ).withColumnRenamed("text_sha256", "__key")
    drop(digests)
    # id and hash together are unique but for repeated rows, so no group is hot here
    stays = tested[key].eqNullSafe(keepers["__key"]) & tested[id_col].eqNullSafe(keepers["__keep"])
    found = tested.where(mark).join(keepers, stays, "left_semi").dropDuplicates([id_col, key])
    return tested.where(~F.col(mark)).unionByName(found).drop(key, mark)
