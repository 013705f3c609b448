"""Text quality of pages and documents: signs of damaged text layers. Native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits (fixed values): characters of a page with little text; shares of private-use, control and replacement characters; share of such pages.
LOW_TEXT, HIGH_PRIVATE, HIGH_CONTROL, HIGH_REPLACEMENT, PAGES = 20, 0.2, 0.05, 0.05, 0.3
#: Damaged Hangul (fixed values): least syllables, greatest share without a final, least share with rare finals, and which finals are rare.
LEAST_HANGUL, MOST_OPEN, LEAST_RARE = 30, 0.15, 0.25
RARE_FINALS = (3, 5, 6, 9, 10, 11, 12, 13, 14, 15, 18, 24, 25, 26)
_SPACE = r"[\x20\t\n\r]"
_CONTROL = r"[\x00-\x1F\x7F\x{80}-\x{9F}]"


def _count(text: Column, char_class: str) -> Column:
    """Characters of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def page_quality(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the counts, ratios and reason for reading a page again, in UTF-16 units as the thresholds are defined in them."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _SPACE, "")
    astral = _count(bare, r"[\x{10000}-\x{10FFFF}]")
    hangul_only = F.regexp_replace(bare, r"[^\x{AC00}-\x{D7A3}]", "")
    # finals repeat every 28 codes; a page's syllables are few, so they are looked at one by one
    final = F.transform(F.filter(F.split(hangul_only, ""), lambda c: c != ""), lambda c: (F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00) % 28)
    rows = texts.select(
        *keys, (F.length(bare) + astral).alias("text_chars"), F.length(hangul_only).alias("hangul"), _count(bare, _CONTROL).alias("control"), _count(bare, r"\x{FFFD}").alias("replacement"),
        (_count(bare, r"[\x{E000}-\x{F8FF}]") + _count(bare, r"[\x{F0000}-\x{10FFFF}]")).alias("private"), F.when(F.length(hangul_only) > 0, final).otherwise(F.array().cast("array<int>")).alias("finals"),
    )
    n, h = F.greatest("text_chars", F.lit(1)), F.greatest("hangul", F.lit(1))
    rows = rows.select(
        *keys, "text_chars", (F.col("hangul") / n).alias("hangul_ratio"), (F.col("control") / n).alias("control_ratio"), (F.col("replacement") / n).alias("replacement_ratio"),
        (F.col("private") / n).alias("pua_ratio"), (F.size(F.filter("finals", lambda x: x == 0)) / h).alias("no_final_ratio"),
        (F.size(F.filter("finals", lambda x: x.isin(*RARE_FINALS))) / h).alias("rare_final_ratio"), F.col("hangul").alias("__hangul"),
    )
    garbled = (F.col("__hangul") >= LEAST_HANGUL) & (F.col("no_final_ratio") < MOST_OPEN) & (F.col("rare_final_ratio") >= LEAST_RARE)
    reason = (
        F.when(F.col("text_chars") < LOW_TEXT, "low_text").when(F.col("pua_ratio") >= HIGH_PRIVATE, "high_pua").when(F.col("control_ratio") >= HIGH_CONTROL, "high_control")
        .when(F.col("replacement_ratio") >= HIGH_REPLACEMENT, "high_replacement").when(garbled, "garbled_hangul")
    )
    return rows.withColumn("ocr_reason", reason).withColumn("needs_ocr", F.col("ocr_reason").isNotNull()).drop("__hangul")


def quality_summary(quality: DataFrame, by: str) -> DataFrame:
    """Means and counts of pages' quality for each group; ratios weigh the same whatever a page's length."""
    mean = lambda c: F.round(F.avg(c), 6).alias(f"avg_{c}")
    return quality.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("text_chars").alias("total_text_chars"), mean("hangul_ratio"), mean("control_ratio"), mean("replacement_ratio"), mean("pua_ratio"),
        F.count_if(F.col("text_chars") < LOW_TEXT).alias("low_text_pages"), F.count_if(F.col("pua_ratio") >= HIGH_PRIVATE).alias("high_pua_pages"),
        (F.count_if("needs_ocr") / F.count(F.lit(1)) >= PAGES).alias("needs_ocr"),
    )


def is_image_based(text_chars: Column, pages: Column) -> Column:
    """Fewer than ten characters a page."""
    return text_chars / F.greatest(pages, F.lit(1)) < 10
