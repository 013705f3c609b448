"""Documents as ordered blocks, pages, headings and running headers.

A block is a row (doc_id, block_id, type, text, level, page_number, list_depth); block_id is its 0-based place in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import length16, trim

_HTML = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1\s*>"


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """Each non-blank line of a text as a paragraph."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text")).withColumn("text", trim(F.col("text")))
    kept = lines.where(F.col("text") != "")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return kept.select("doc_id", place.alias("block_id"), F.lit("paragraph").alias("type"), "text", F.lit(None).cast("int").alias("level"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs and list items of web pages, tags and entities resolved, in document order; scripts and styles don't count."""
    bare = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    both = F.arrays_zip(F.regexp_extract_all(bare, F.lit(_HTML), F.lit(1)).alias("tag"), F.regexp_extract_all(bare, F.lit(_HTML), F.lit(2)).alias("inner"))
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(both).alias("block_id", "b"))
    text = F.regexp_replace(F.col("b.inner"), r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    tag = F.lower(F.col("b.tag"))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "list").otherwise("paragraph")
    return rows.select("doc_id", "block_id", kind.alias("type"), trim(text).alias("text"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("level"))


def outline(blocks: DataFrame) -> DataFrame:
    """Headings with text."""
    return blocks.where((F.col("type") == "heading") & (F.coalesce("text", F.lit("")) != "")).select("doc_id", "block_id", "level", "text")


def page_range(specs: DataFrame, spec: str = "spec", most: str = "max_pages") -> DataFrame:
    """specs' columns and a row for each page that a spec like `1,3,5-7` names, within 1 and the maximum; garbage is dropped."""
    part = trim(F.col("__part"))
    first, last = F.regexp_extract(part, r"^(\d+)\s*-\s*(\d+)$", 1), F.regexp_extract(part, r"^(\d+)\s*-\s*(\d+)$", 2)
    alone = F.regexp_extract(part, r"^[+-]?\d+", 0)
    lo = F.when(first != "", F.greatest(F.lit(1), first.try_cast("int"))).otherwise(alone.try_cast("int"))
    hi = F.when(first != "", F.least(F.col(most), last.try_cast("int"))).otherwise(alone.try_cast("int"))
    rows = specs.withColumn("__part", F.explode(F.split(F.col(spec), ","))).withColumn("__lo", lo).withColumn("__hi", hi)
    fine = rows.where((F.col("__lo") >= 1) & (F.col("__hi") <= F.col(most)) & (F.col("__lo") <= F.col("__hi")))
    return fine.withColumn("page", F.explode(F.sequence("__lo", "__hi"))).drop("__part", "__lo", "__hi").distinct()


def filter_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks whose page is among pages (page); blocks without one go."""
    return blocks.join(pages.select(F.col("page").alias("page_number")).distinct(), "page_number", "left_semi")


def assign_pages(blocks: DataFrame) -> DataFrame:
    """blocks with page: their own number, else that of the block before, else the document's first; documents without any number are left out."""
    order = Window.partitionBy("doc_id").orderBy("block_id")
    whole = Window.partitionBy("doc_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    page = F.coalesce(F.last("page_number", ignorenulls=True).over(order), F.first("page_number", ignorenulls=True).over(whole))
    return blocks.withColumn("page", page).where("page is not null")


def page_markdown(blocks: DataFrame, markdown: str = "text") -> DataFrame:
    """(doc_id, page_number, markdown) for each page from the least to the greatest, empty ones included."""
    paged = assign_pages(blocks)
    parts = F.sort_array(F.collect_list(F.when(F.coalesce(F.col(markdown), F.lit("")) != "", F.struct("block_id", F.col(markdown).alias("m")))))
    texts = paged.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["m"]), "\n\n").alias("markdown"))
    span = paged.groupBy("doc_id").agg(F.sequence(F.min("page"), F.max("page")).alias("pages")).select("doc_id", F.explode("pages").alias("page"))
    return span.join(texts, ["doc_id", "page"], "left").select("doc_id", F.col("page").alias("page_number"), F.coalesce("markdown", F.lit("")).alias("markdown"))


def is_running_header(kind: Column, text: Column) -> Column:
    """Paragraphs and headings of up to 40 characters that begin with a number and a dot."""
    bare = trim(F.coalesce(text, F.lit("")))
    return kind.isin("paragraph", "heading") & (F.length(bare) <= 40) & bare.rlike(r"^\d+\.\s")


def dedupe_running_headers(blocks: DataFrame, least: int = 3) -> DataFrame:
    """blocks without the repeats of headers that occur `least` times or more; the first of each stays."""
    candidate = is_running_header(F.col("type"), F.col("text"))
    same = Window.partitionBy("doc_id", "__key")
    marked = blocks.withColumn("__candidate", candidate).withColumn("__key", F.when(candidate, trim(F.col("text"))))
    heads = marked.where("__candidate").withColumn("__n", F.count(F.lit(1)).over(same)).withColumn("__k", F.row_number().over(same.orderBy("block_id")))
    kept = heads.where((F.col("__n") < least) | (F.col("__k") == 1))
    return marked.where("not __candidate").unionByName(kept.drop("__n", "__k")).drop("__candidate", "__key")


def remove_header_footer(items: DataFrame, zone: float = 0.12, least: int = 3) -> DataFrame:
    """Positioned blocks (doc_id, page, block_id, text, y, height, page_height; y from the page's bottom) without headers and footers.

    In the top and bottom zones, texts whose digits count as alike and that occur on `least` pages or more go, in documents of that many pages; a block
    stays that shares half of its height with a block outside of that set on its page.
    """
    middle = F.col("y") + F.col("height") / 2
    where = F.when(middle >= (1 - zone) * F.col("page_height"), "top").when(middle <= zone * F.col("page_height"), "bottom")
    rows = items.withColumn("__zone", where).withColumn("__pattern", F.regexp_replace(trim(F.coalesce("text", F.lit(""))), r"\d+", "#"))
    repeated = rows.where("__zone is not null and __pattern <> ''").groupBy("doc_id", "__zone", "__pattern").agg(F.countDistinct("page").alias("__pages")).where(F.col("__pages") >= least)
    rows = rows.join(repeated, ["doc_id", "__zone", "__pattern"], "left").withColumn("__gone", F.col("__pages").isNotNull())
    body = rows.where("not __gone").select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("y").alias("y2"), F.col("height").alias("h2"))
    shared = F.least(F.col("y") + F.col("height"), F.col("y2") + F.col("h2")) - F.greatest("y", "y2")
    gone = rows.where("__gone").join(body, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & (shared >= 0.5 * F.col("height")), "left_anti")
    return rows.join(gone.select("doc_id", "page", "block_id"), ["doc_id", "page", "block_id"], "left_anti").drop("__zone", "__pattern", "__pages", "__gone")


def weighted_median(sizes: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, median): the first value whose cumulated weight exceeds half of the total, rounded down."""
    order = Window.partitionBy(by).orderBy(value)
    summed = sizes.groupBy(by, value).agg(F.sum(weight).alias("w"))
    ranked = summed.withColumn("upto", F.sum("w").over(order)).withColumn("total", F.sum("w").over(Window.partitionBy(by)))
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(by).agg(F.min(value).alias("median"))


def heading_level(size: Column, median: Column) -> Column:
    """1, 2 or 3 by the ratio of font sizes, else null."""
    ratio = size / median
    return F.when(ratio >= 1.5, 1).when(ratio >= 1.3, 2).when(ratio >= 1.15, 3)


def detect_headings(blocks: DataFrame, medians: DataFrame) -> DataFrame:
    """blocks with font_size, of which paragraphs in large print become headings; medians: (doc_id, median)."""
    level = heading_level(F.col("font_size"), F.col("median"))
    fits = (F.col("type") == "paragraph") & (F.length("text") <= 200) & ~trim(F.col("text")).rlike(r"^\d+$") & level.isNotNull()
    joined = blocks.join(medians, "doc_id", "left")
    return joined.withColumn("level", F.when(fits, level).otherwise(F.col("level"))).withColumn("type", F.when(fits, "heading").otherwise(F.col("type"))).drop("median")


#: Order of the syllables that label lists (fixed values).
SYLLABLES = "가나다라마바사아자차카타파하"


def list_label(text: Column) -> tuple[Column, Column]:
    """Family and ordinal of a list label at a text's start, or nulls."""
    bare = trim(text)
    decimal, bracket = F.regexp_extract(bare, r"^(\d{1,3})\.\s", 1), F.regexp_extract(bare, r"^(\d{1,3})\)\s", 1)
    syllable, closed, circled = F.regexp_extract(bare, f"^([{SYLLABLES}])\\.\\s", 1), F.regexp_extract(bare, f"^([{SYLLABLES}])\\)\\s", 1), F.regexp_extract(bare, "^([①-⑳])", 1)
    at = lambda x: F.position(x, F.lit(SYLLABLES))
    family = F.when(decimal != "", "decimal").when(syllable != "", "syllable").when(bracket != "", "decimal)").when(closed != "", "syllable)").when(circled != "", "circled")
    ordinal = F.when(decimal != "", decimal.try_cast("int")).when(syllable != "", at(syllable)).when(bracket != "", bracket.try_cast("int")).when(closed != "", at(closed)).when(circled != "", F.position(circled, F.lit("".join(chr(0x2460 + i) for i in range(20)))))
    return family, ordinal


def list_chains(blocks: DataFrame, most_gap: int = 20) -> DataFrame:
    """Blocks that belong to a chain of list labels: one family, ordinals rising by one, gaps of at most `most_gap` blocks, two members or more.

    Tables, headings and separators end chains. Adds family, ordinal and chain (the block_id of its first member).
    """
    family, ordinal = list_label(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("doc_id").orderBy("block_id")
    rows = blocks.withColumn("__reset", F.sum(F.when(F.col("type").isin("table", "heading", "separator"), 1).otherwise(0)).over(order))
    rows = rows.withColumn("family", family).withColumn("ordinal", ordinal).where("family is not null and type in ('paragraph', 'list')")
    own = Window.partitionBy("doc_id", "__reset", "family").orderBy("block_id")
    joins = (F.col("ordinal") == F.lag("ordinal").over(own) + 1) & (F.col("block_id") - F.lag("block_id").over(own) <= most_gap)
    rows = rows.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("__chain", F.sum("__new").over(own))
    members = Window.partitionBy("doc_id", "__reset", "family", "__chain")
    return rows.withColumn("__n", F.count(F.lit(1)).over(members)).withColumn("chain", F.min("block_id").over(members)).where("__n >= 2").drop("__reset", "__new", "__chain", "__n")


def marker_headings(blocks: DataFrame) -> DataFrame:
    """blocks with font_size, of which short paragraphs that begin with a square or similar become headings of level 4, and lone Hangul words of 2 to 6 syllables next to tables, headings, separators or an end of the document headings of level 3.

    A word also counts as next to a heading if the word before it has become one, so that a run of words follows its first one that does.
    """
    order = Window.partitionBy("doc_id").orderBy("block_id")
    bare, plain = trim(F.col("text")), (F.col("type") == "paragraph") & (F.col("text") != "")
    rows = blocks.withColumn("__marked", F.coalesce(plain & (length16(bare) < 50) & bare.rlike(r"^[□■◆◇▶]\s*[가-힣]"), F.lit(False)))
    rows = rows.withColumn("__word", F.coalesce(plain & ~F.col("__marked") & bare.rlike(r"^[가-힣]{2,6}$") & (F.col("font_size") != 0), F.lit(False)))
    rows = rows.withColumn("__kind", F.when(F.col("__marked"), "heading").otherwise(F.col("type"))).withColumn("__opens", F.coalesce(plain & bare.rlike("^[□■◆○●]"), F.lit(False)))
    before, after = F.lag("__kind").over(order), F.lead("type").over(order)
    near = before.isNull() | before.isin("table", "heading", "separator") | after.isNull() | after.isin("table", "heading") | F.lead("__opens").over(order)
    rows = rows.withColumn("__near", F.col("__word") & near).withColumn("__run", F.sum(F.when(F.col("__word"), 0).otherwise(1)).over(order))
    titled = F.col("__word") & F.max("__near").over(Window.partitionBy("doc_id", "__run").orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", F.when(F.col("__marked"), 4).when(titled, 3).otherwise(F.col("level")))
    return rows.withColumn("type", F.when(F.col("__marked") | titled, "heading").otherwise(F.col("type"))).drop("__marked", "__word", "__kind", "__opens", "__near", "__run")
