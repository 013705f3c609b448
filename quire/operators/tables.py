"""Tables as rows of cells: grids from spanned cells, markdown, text, and differences.

Cells are rows (keys..., r, c, text, col_span, row_span). The grid's limits are 200 columns and 10,000 rows.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import trim

MOST_COLS, MOST_ROWS = 200, 10_000


def covered_positions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c) of the places that spans cover, without their anchors."""
    down = F.explode(F.sequence(F.col("r"), F.least(F.col("r") + F.col("row_span"), F.lit(MOST_ROWS)) - 1)).alias("r2")
    wide = cells.where("col_span > 1 or row_span > 1").select(*keys, "r", "c", "col_span", down)
    places = wide.select(*keys, "r", "c", "r2", F.explode(F.sequence(F.col("c"), F.least(F.col("c") + F.col("col_span"), F.lit(MOST_COLS)) - 1)).alias("c2"))
    return places.where("r2 <> r or c2 <> c").select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c")).distinct()


def build_grid(cells: DataFrame, keys: list[str], keep_anchored: bool = False) -> DataFrame:
    """Addressed cells as a full grid: (keys, r, c, text, col_span, row_span, is_anchor, is_header).

    Places under a span are blank; later cells (src_idx, if there) win a place; columns at the right that are blank all the way go, unless
    all are or, with keep_anchored, a cell begins there. is_header marks the first of several rows.
    """
    inside = cells.where(f"r >= 0 and c >= 0 and c < {MOST_COLS} and r < {MOST_ROWS}").withColumn("text", trim(F.coalesce("text", F.lit(""))))
    later = F.col("src_idx").desc() if "src_idx" in cells.columns else F.col("text").desc()
    one = inside.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "r", "c").orderBy(later))).where("__k = 1").drop("__k")
    anchors = one.join(covered_positions(one, keys), [*keys, "r", "c"], "left_anti")
    size = one.groupBy(*keys).agg((F.max("r") + 1).alias("rows"), F.least(F.max(F.col("c") + F.col("col_span")), F.lit(MOST_COLS)).alias("cols"))
    last = anchors.where("text <> ''" + (" or true" if keep_anchored else "")).groupBy(*keys).agg((F.max("c") + 1).alias("used"))
    size = size.join(last, keys, "left").withColumn("cols", F.coalesce(F.least("used", "cols"), "cols")).drop("used")
    places = size.select(*keys, "rows", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "cols").select(*keys, "rows", "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    full = places.join(anchors.select(*keys, "r", "c", "text", "col_span", "row_span", F.lit(True).alias("is_anchor")), [*keys, "r", "c"], "left")
    return full.select(
        *keys, "r", "c", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("col_span", F.lit(1)).alias("col_span"), F.coalesce("row_span", F.lit(1)).alias("row_span"),
        F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), ((F.col("r") == 0) & (F.col("rows") > 1)).alias("is_header"),
    )


def _ordered(what: Column, by: str) -> Column:
    """Values in order of a column."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(by), what.alias("x")))), lambda s: s["x"])


def cell_markdown(text: Column) -> Column:
    """A cell's text in one line, pipes escaped."""
    return F.regexp_replace(F.replace(trim(text), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>")


def to_markdown(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown): pipe tables; one column as lines, one cell as its text; merged cells as HTML."""
    sizes = grid.groupBy(*keys).agg((F.max("c") + 1).alias("cols"), F.max((F.col("col_span") > 1) | (F.col("row_span") > 1)).alias("merged"))
    md = F.concat(F.lit("| "), F.array_join(_ordered(cell_markdown(F.col("text")), "c"), " | "), F.lit(" |"))
    tag = F.when(F.col("r") == 0, "th").otherwise("td")
    span = lambda name, col: F.when(F.col(col) > 1, F.concat(F.lit(f' {name}="'), F.col(col).cast("string"), F.lit('"'))).otherwise("")
    inner = F.regexp_replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\n", "<br>")
    html_cell = F.when(F.col("is_anchor"), F.concat(F.lit("<"), tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))).otherwise("")
    rows = grid.groupBy(*keys, "r").agg(md.alias("md"), F.concat(F.lit("<tr>"), F.array_join(_ordered(html_cell, "c"), ""), F.lit("</tr>")).alias("html"), F.max("text").alias("any"), F.array_join(_ordered(trim(F.col("text")), "c"), "").alias("plain"))
    tables = rows.groupBy(*keys).agg(_ordered(F.col("md"), "r").alias("md"), F.array_join(_ordered(F.col("html"), "r"), "\n").alias("html"), F.array_join(F.filter(_ordered(F.col("plain"), "r"), lambda x: x != ""), "\n").alias("plain"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("cols").cast("int")), " | "), F.lit(" |"))
    body = F.slice(F.col("md"), F.lit(2), F.greatest(F.size("md") - 1, F.lit(0)))
    pipes = F.array_join(F.concat(F.array(F.element_at("md", 1), rule), body), "\n")
    whole = F.when(F.col("merged"), F.concat(F.lit("<table>\n"), F.col("html"), F.lit("\n</table>"))).when(F.col("cols") == 1, F.col("plain")).otherwise(pipes)
    return tables.join(sizes, keys).select(*keys, whole.alias("markdown"))


def to_text(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): cells parted by slashes, rows by line ends; empty ones left out."""
    cell = F.replace(F.regexp_replace(trim(F.col("text")), "\n", " "), F.lit("|"), F.lit("\\|"))
    rows = grid.groupBy(*keys, "r").agg(F.array_join(F.filter(_ordered(cell, "c"), lambda x: x != ""), " / ").alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.filter(_ordered(F.col("line"), "r"), lambda x: x != ""), "\n").alias("text"))


def parse_markdown_rows(tables: DataFrame, keys: list[str], markdown: str = "markdown") -> DataFrame:
    """Cells (keys, r, c, text) of pipe tables; rules of three dashes or more are no rows."""
    lines = tables.select(*keys, F.posexplode(F.split(F.col(markdown), "\n")).alias("line", "row")).withColumn("row", trim(F.col("row")))
    inner = F.regexp_replace(F.col("row"), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(trim(x), F.lit("\\|"), F.lit("|")))
    rows = lines.where(F.col("row").startswith("|")).withColumn("cells", cells).where(~F.forall("cells", lambda x: x.rlike("^:?-{3,}:?$")))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("line")) - 1)
    return numbered.select(*keys, "r", F.posexplode("cells").alias("c", "text"))


class _HtmlRows(HTMLParser):
    """The rows of the outermost table: lists of (text, col_span, row_span); what lies in inner tables stays as source."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int, int]]] = []
        self.depth, self.broken, self.row, self.span, self.parts = 0, False, None, None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.depth += tag == "table"
        if self.depth > 1:
            self.parts.append(self.get_starttag_text())
        elif self.depth == 1 and tag == "tr":
            self.row = []
        elif self.depth == 1 and tag in ("td", "th"):
            named = dict(attrs)
            self.span, self.parts = (_span(named.get("colspan"), MOST_COLS), _span(named.get("rowspan"), MOST_ROWS)), []
        elif self.depth == 1 and tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.depth > 1:
            self.parts.append(f"</{tag}>")
        elif self.depth == 1 and tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif self.depth == 1 and tag in ("td", "th") and self.span and self.row is not None:
            self.row.append(("".join(self.parts).strip(), *self.span))
            self.span = None
        self.depth -= tag == "table"
        self.broken |= self.depth < 0

    def handle_data(self, data: str) -> None:
        self.parts.append(html.escape(data, quote=False) if self.depth > 1 else data)


def _span(value: str | None, most: int) -> int:
    return max(1, min(int(value), most)) if value and value.isascii() and value.isdigit() else 1


def html_cells(source: str | None) -> Iterator[tuple[int, int, str, int, int]]:
    """(r, c, text, col_span, row_span) of an HTML table; nothing where its tags don't pair up."""
    parser = _HtmlRows()
    parser.feed(source or "")
    parser.close()
    if parser.broken or parser.depth:
        return
    free_from: dict[int, int] = {}
    for r, row in enumerate(parser.rows[:MOST_ROWS]):
        c = 0
        for text, wide, tall in row:
            while free_from.get(c, 0) > r:
                c += 1
            yield r, c, text, wide, tall
            free_from.update(dict.fromkeys(range(c, c + wide), r + tall))
            c += wide


def parse_html_cells(tables: DataFrame, keys: list[str], source: str = "markdown") -> DataFrame:
    """Addressed cells (keys, r, c, text, col_span, row_span) of HTML tables: spans push later cells on, <br> ends a line, other tags go, inner tables stay as source.

    Null and empty texts and tables whose tags don't pair up give no cells.
    """

    @F.pandas_udf("array<struct<r:int,c:int,text:string,col_span:int,row_span:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("r", "c", "text", "col_span", "row_span"), cell, strict=True)) for cell in html_cells(x)] for x in texts], dtype=object)

    return tables.select(*keys, F.explode(run(F.col(source))).alias("__cell")).select(*keys, "__cell.*")


def cell_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, c, type, before, after) by place: added, removed, modified or unchanged."""
    a, b = before.select(*keys, "r", "c", F.col("text").alias("before")), after.select(*keys, "r", "c", F.col("text").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    return a.join(b, [*keys, "r", "c"], "full").select(*keys, "r", "c", kind.alias("type"), "before", "after")


def flatten_layout(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs (keys, r, c, line, text) of tables that only lay out text.

    These have at most three rows and three columns, more than one cell, and more than five line ends or, in two rows at most, over 300 characters.
    """
    stats = grid.groupBy(*keys).agg(
        (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("breaks"), F.sum(F.length("text")).alias("chars"),
    )
    layout = stats.where("rows <= 3 and cols < 4 and rows * cols > 1 and (breaks > 5 or (rows <= 2 and chars > 300))").select(*keys)
    lines = grid.join(layout, keys, "left_semi").select(*keys, "r", "c", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("text", trim(F.col("text")))
    return lines.where("text <> ''")


def merge_cross_page(tables: DataFrame, grid: DataFrame) -> DataFrame:
    """Tables that go on over pages as one: (doc_id, table_id, r, c, text).

    tables: (doc_id, table_id in reading order, page, cols, left, right). A table goes on with the next one if that is on the next page, has as many columns
    and its edges differ by less than a fifth of the width. A first row that repeats the whole table's first row is dropped.
    """
    order = Window.partitionBy("doc_id").orderBy("table_id")
    width = F.greatest(F.lag("right").over(order) - F.lag("left").over(order), F.lit(1e-9))
    near = lambda c: F.abs(F.col(c) - F.lag(c).over(order)) < 0.2 * width
    goes_on = (F.col("page") == F.lag("page").over(order) + 1) & (F.col("cols") == F.lag("cols").over(order)) & near("left") & near("right")
    heads = tables.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(order))
    heads = heads.withColumn("head", F.min("table_id").over(Window.partitionBy("doc_id", "__run"))).select("doc_id", "table_id", "head")
    cells = grid.join(heads, ["doc_id", "table_id"])
    first = F.regexp_replace(F.array_join(_ordered(F.col("text"), "c"), "|"), r"\s+", "")
    rows = cells.groupBy("doc_id", "head", "table_id", "r").agg(first.alias("key"))
    top = rows.where("table_id = head and r = 0").select("doc_id", "head", F.col("key").alias("top"))
    rows = rows.join(top, ["doc_id", "head"]).where(~((F.col("r") == 0) & (F.col("table_id") != F.col("head")) & (F.col("key") == F.col("top")) & F.col("key").rlike("[^|]")))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id", "head").orderBy("table_id", "r")) - 1)
    return cells.join(rows.select("doc_id", "table_id", "r", "__r"), ["doc_id", "table_id", "r"]).select("doc_id", F.col("head").alias("table_id"), F.col("__r").alias("r"), "c", "text")
