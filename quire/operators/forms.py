"""Forms: fields from tables and lines, their types, and matching of labels to given values. Native columns only.

Grids are rows (keys..., table_id, r, c, text); blocks are rows (keys..., block_id, type, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.fields import field_type, is_empty_value, is_label_cell, is_required_label, normalize_label
from quire.functions.text import WHITE, trim

_INLINE = r"([가-힣A-Za-z]{2,}(?:[ ]?[가-힣A-Za-z]{2,})?)\s*[:：](?!//)[ \t]*([^\n,;]{0,100}?)(?=\s+[가-힣A-Za-z]{2,}\s*[:：](?!//)|[,;\n]|$)"


def table_fields(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_id, label, value, r, c) of tables: cells right of labels, or cells under a first row of short texts where no label was found."""
    table = [*keys, "table_id"]
    row = Window.partitionBy(*table, "r").orderBy("c")
    pairs = grid.withColumn("value", F.lead("text").over(row)).where(F.col("value").isNotNull() & is_label_cell(F.col("text")))
    near = pairs.select(*table, F.regexp_replace(trim(F.col("text")), r"[:：]\s*$", "").alias("label"), trim(F.col("value")).alias("value"), "r", "c")
    shape = grid.groupBy(*table).agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.min(F.when(F.col("r") == 0, F.length(trim(F.col("text"))).between(1, 20))).alias("short"))
    headed = shape.where("short and rows >= 2 and cols >= 2").select(*table).join(near.select(*table).distinct(), table, "left_anti")
    heads = grid.where("r = 0").select(*table, "c", trim(F.col("text")).alias("label"))
    below = grid.where("r > 0 and trim(text) <> ''").join(headed, table, "left_semi").join(heads, [*table, "c"])
    return near.unionByName(below.select(*table, "label", trim(F.col("text")).alias("value"), "r", "c"))


def inline_fields(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, label, value) of `label: value` in paragraphs; values end at the next label, a comma, a semicolon or the line's end."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(_INLINE), F.lit(1)).alias("label"), F.regexp_extract_all("text", F.lit(_INLINE), F.lit(2)).alias("value"))
    rows = blocks.where("type = 'paragraph' and text is not null").select(*keys, "block_id", F.explode(both).alias("f"))
    return rows.select(*keys, "block_id", trim(F.col("f.label")).alias("label"), trim(F.col("f.value")).alias("value"))


def form_fields(grid: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, value, r, c): fields of tables, and of lines with r and c of -1."""
    lines = inline_fields(blocks, keys).where("value <> ''").select(*keys, "label", "value", F.lit(-1).alias("r"), F.lit(-1).alias("c"))
    return table_fields(grid, keys).select(*keys, "label", "value", "r", "c").unionByName(lines)


def form_schema(fields: DataFrame) -> DataFrame:
    """fields with type, required and empty."""
    return fields.withColumns({"type": field_type(F.col("label"), F.col("value")), "required": is_required_label(F.col("label")), "empty": is_empty_value(F.col("value"))})


def form_confidence(grid: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence): the share of tables with fields; 0.3 where only lines have some."""
    tables = grid.groupBy(*keys).agg(F.countDistinct("table_id").alias("tables"))
    with_fields = table_fields(grid, keys).groupBy(*keys).agg(F.countDistinct("table_id").alias("forms"))
    alone = fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("fields"))
    joined = alone.join(tables, keys, "full").join(with_fields, keys, "full")
    share = F.when(F.col("tables") > 0, F.coalesce("forms", F.lit(0)) / F.col("tables")).when(F.col("fields") > 0, 0.3).otherwise(0.0)
    return joined.select(*keys, F.least(share, F.lit(1.0)).alias("confidence"))


def match_keys(labels: DataFrame, values: DataFrame) -> DataFrame:
    """labels' columns and the key of values (key, key_no) that fits each label, or null.

    Equal after normalising; else the longest match by prefix, of which a key must make up 60 % of the label, or a label 75 % of the key; ties go to the
    lowest key_no. Prefixes meet by their first character, so that no label meets every key.
    """
    named = labels.withColumn("__label", normalize_label(F.col("label"))).withColumn("__id", F.monotonically_increasing_id())
    rows, keys = named.select("__label").distinct(), values.select("key", "key_no", normalize_label(F.col("key")).alias("__key"))
    met = rows.join(keys, F.substring("__label", 1, 1) == F.substring("__key", 1, 1))
    n, k = F.length("__label"), F.length("__key")
    score = (
        F.when(F.col("__label") == F.col("__key"), 1_000_000).when(F.col("__label").startswith(F.col("__key")) & (k >= 0.6 * n), k)
        .when(F.col("__key").startswith(F.col("__label")) & (n >= 0.75 * k), n)
    )
    best = met.withColumn("score", score).where("score is not null").withColumn("k", F.row_number().over(Window.partitionBy("__label").orderBy(F.desc("score"), "key_no"))).where("k = 1")
    return named.join(best.select("__label", F.col("key").alias("matched_key")), "__label", "left").drop("__label", "__id")


def unmatched(values: DataFrame, matches: DataFrame) -> DataFrame:
    """Values whose key no label has."""
    return values.join(matches.select(F.col("matched_key").alias("key")).distinct(), "key", "left_anti")


def unique_guard(matches: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches that may be filled, keys that are refused): a single value that fits two places or more is refused; lists of values are taken in order."""
    places = matches.where("matched_key is not null").groupBy("matched_key").agg(F.count(F.lit(1)).alias("places"))
    single = values.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    refused = places.where("places >= 2").join(single, F.col("matched_key") == F.col("key"), "left_semi").select(F.col("matched_key").alias("key"))
    return matches.join(refused, matches["matched_key"] == refused["key"], "left_anti").where("matched_key is not null"), refused


def fill_values(matches: DataFrame, values: DataFrame, order: list[str]) -> DataFrame:
    """matches with the value each place gets: lists (key, value_index, value) are used up in the given order, single values repeat."""
    counted = values.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    numbered = matches.withColumn("__k", F.row_number().over(Window.partitionBy("matched_key").orderBy(*order)) - 1)
    own = counted.select(F.col("key").alias("__key"), "value_index", F.col("value").alias("filled"), "n")
    fits = (F.col("matched_key") == F.col("__key")) & ((F.col("n") == 1) | (F.col("__k") == F.col("value_index")))
    return numbered.join(own, fits, "left").drop("__k", "__key", "value_index", "n")


def has_blank(text: str = "text"):
    """Texts with runs of white space, which forms use as blanks."""
    return F.col(text).rlike(f"{WHITE}{{2,}}")
