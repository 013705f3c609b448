"""Reading order and columns of positioned text: pages are groups, each folded in one task.

Items are rows (doc_id, page, item_id, text, x, y, w, h) with y growing upwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.operators.folding import folded

#: Deepest recursion of cuts; how much wider a vertical gap must be to be cut first; how far items may lie beyond the page, as a share of its longer side; how much items of a line differ in y (fixed values).
MOST_DEPTH, PREFER, BEYOND, SAME_LINE = 50, 1.5, 0.1, 3.0


def _gap(starts: np.ndarray, ends: np.ndarray) -> tuple[float, float]:
    """The widest empty stretch between intervals: its size and its middle."""
    order = np.argsort(starts, kind="stable")
    reach = np.maximum.accumulate(ends[order])[:-1]
    gaps = starts[order][1:] - reach
    if not len(gaps) or gaps.max() <= 0:
        return 0.0, 0.0
    k = int(gaps.argmax())
    return float(gaps[k]), float(reach[k] + gaps[k] / 2)


def cut_order(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, least: float = 1.0, depth: int = 0) -> list[int]:
    """Places of boxes in reading order, by recursive cuts along the widest gaps; horizontal cuts go first unless the vertical gap is much wider."""
    n = len(x)
    flat, at = _gap(y, y + h)
    tall, across = _gap(x, x + w)
    if n <= 1 or depth >= MOST_DEPTH or max(flat, tall) < least:
        return np.lexsort((x, -(y + h))).tolist()
    first = (x + w / 2 < across) if tall > PREFER * flat else (y + h / 2 > at)
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    if not len(a) or not len(b):
        return np.lexsort((x, -(y + h))).tolist()
    return [int(part[k]) for part in (a, b) for k in cut_order(x[part], y[part], w[part], h[part], least, depth + 1)]


def reading_order(items: DataFrame, least_gap: float = 1.0) -> DataFrame:
    """items with read_no, their place in reading order on the page."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("item_id").reset_index(drop=True)
        order = cut_order(*(own[c].to_numpy(float) for c in "xywh"), least_gap)
        return own.iloc[order].assign(read_no=np.arange(len(own), dtype=np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields if f.name != "read_no")
    return items.drop("read_no").groupBy("doc_id", "page").applyInPandas(fold, f"{fields}, read_no int")


def visible_items(items: DataFrame) -> DataFrame:
    """Items that a reader of the page (page_w, page_h) sees: not those without height, those with text but no width, and those a tenth of the page or more outside. Nulls hide nothing."""
    far = F.greatest("page_w", "page_h") * BEYOND
    hidden = (F.col("h") == 0) | ((F.col("w") == 0) & F.col("text").rlike(r"\S"))
    outside = (F.col("x") < -far) | (F.col("x") > F.col("page_w") + far) | (F.col("y") < -far) | (F.col("y") > F.col("page_h") + far)
    return items.where(~F.coalesce(hidden, F.lit(False)) & ~F.coalesce(outside, F.lit(False)))


def line_numbers(items: DataFrame, tolerance: float = SAME_LINE) -> DataFrame:
    """items with line_no: in order of item_id on a page, an item further than the tolerance from its line's first item begins a line. Items without y stay in the line."""

    def step(state: dict, y: float | None) -> int:
        if "y" not in state:
            state["line"], state["y"] = 0, y
        elif state["y"] is None:
            state["y"] = y
        elif y is not None and abs(y - state["y"]) > tolerance:
            state["line"], state["y"] = state["line"] + 1, y
        return state["line"]

    return folded(items, ["doc_id", "page"], ["item_id"], ["y"], dict, step, "line_no", IntegerType(), pa.int32())


def clusters(values: np.ndarray, tolerance: float) -> np.ndarray:
    """A cluster number for each value: in rising order, a value joins the last cluster when it is within the tolerance of its mean."""
    out, total, count, k = np.zeros(len(values), np.int64), 0.0, 0, -1
    for i in np.argsort(values, kind="stable").tolist():
        if not count or values[i] - total / count > tolerance:
            total, count, k = 0.0, 0, k + 1
        total, count = total + values[i], count + 1
        out[i] = k
    return out


def aligned_cells(items: DataFrame, row_tolerance: float = 3.0, col_tolerance: float = 12.0) -> DataFrame:
    """(doc_id, page, r, c, text): items as cells of the rows and columns that their edges line up to."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("item_id")
        r, c = clusters(-own["y"].to_numpy(float), row_tolerance), clusters(own["x"].to_numpy(float), col_tolerance)
        own = own.assign(r=r.astype(np.int32), c=c.astype(np.int32)).sort_values(["r", "c", "x"])
        return own.groupby(["doc_id", "page", "r", "c"], as_index=False).agg(text=("text", " ".join))[["doc_id", "page", "r", "c", "text"]]

    return items.groupBy("doc_id", "page").applyInPandas(fold, "doc_id long, page int, r int, c int, text string")


def items_in_cells(items: DataFrame, cells: DataFrame, bucket: float = 50.0) -> DataFrame:
    """Items with the cell (doc_id, page, r, c, x1, y1, x2, y2) that holds their middle.

    Items and cells meet in stripes of the page, so that a page's items don't meet all of its cells.
    """
    middle = items.withColumn("__x", F.col("x") + F.col("w") / 2).withColumn("__y", F.col("y") + F.col("h") / 2).withColumn("__stripe", F.floor(F.col("__y") / bucket))
    striped = cells.withColumn("__stripe", F.explode(F.sequence(F.floor(F.col("y1") / bucket), F.floor(F.col("y2") / bucket))))
    inside = "__x >= x1 and __x < x2 and __y >= y1 and __y < y2"
    return middle.join(striped, ["doc_id", "page", "__stripe"]).where(inside).drop("__x", "__y", "__stripe", "x1", "y1", "x2", "y2")


def marked_items(items: DataFrame, rulings: DataFrame, bucket: float = 20.0, coverage: float = 0.6) -> DataFrame:
    """items with underlined and struck, by horizontal rulings (doc_id, page, x1, x2, y) that run under or through most of them."""
    striped = items.withColumn("__stripe", F.explode(F.array(F.floor(F.col("y") / bucket) - 1, F.floor(F.col("y") / bucket), F.floor(F.col("y") / bucket) + 1)))
    lines = rulings.select("doc_id", "page", "x1", "x2", F.col("y").alias("__line"), F.floor(F.col("y") / bucket).alias("__stripe"))
    met = striped.join(lines, ["doc_id", "page", "__stripe"])
    share = (F.least(F.col("x") + F.col("w"), F.col("x2")) - F.greatest("x", "x1")) / F.col("w")
    height = (F.col("__line") - F.col("y")) / F.col("h")
    seen = met.where(share >= coverage).groupBy("doc_id", "page", "item_id").agg(F.max(height.between(-0.25, 0.15)).alias("underlined"), F.max((height > 0.15) & (height <= 0.7)).alias("struck"))
    none = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return items.join(seen, ["doc_id", "page", "item_id"], "left").select(*[F.col(c) for c in items.columns], none("underlined"), none("struck"))


def components_of_lines(lines: DataFrame, reach: float = 2.0) -> DataFrame:
    """lines (doc_id, page, line_id, x1, y1, x2, y2) with group: those that touch, directly or over others, share one."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("line_id").reset_index(drop=True)
        box = own[["x1", "y1", "x2", "y2"]].to_numpy(float)
        lo, hi = np.minimum(box[:, :2], box[:, 2:]) - reach / 2, np.maximum(box[:, :2], box[:, 2:]) + reach / 2
        group, order = np.arange(len(own)), np.argsort(lo[:, 0], kind="stable")

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        open_: list[int] = []
        for i in order.tolist():
            open_ = [j for j in open_ if hi[j, 0] >= lo[i, 0]]
            for j in open_:
                if lo[i, 1] <= hi[j, 1] and lo[j, 1] <= hi[i, 1] and (a := root(i)) != (b := root(j)):
                    group[max(a, b)] = min(a, b)
            open_.append(i)
        return own.assign(group=[int(own["line_id"].iloc[root(i)]) for i in range(len(own))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.groupBy("doc_id", "page").applyInPandas(fold, f"{fields}, group long")


def bounding_boxes(items: DataFrame, keys: list[str], order: str = "item_id") -> DataFrame:
    """For each group its box (x, y, width, height) and most frequent font size with the font that first has it.

    Items without height count with their font size instead. Of sizes equally frequent the one that got there first counts; sizes of 0 and
    below don't, and where there are no others size and font are null. Empty font names are null. Order must be total within the keys.
    """
    tall = F.when(F.col("h") > 0, F.col("h")).otherwise(F.col("font_size"))
    font = F.nullif(F.col("font_name"), F.lit(""))
    sizes = items.groupBy(*keys, "font_size").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + tall).alias("top"),
        F.count(F.lit(1)).alias("often"), F.max(order).alias("last"), F.min(F.struct(F.col(order), font.alias("font")))["font"].alias("font"),
    )
    rank = F.when(F.col("font_size") > 0, F.struct(-F.col("often"), F.col("last")))
    return sizes.groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("right") - F.min("x")).alias("width"), (F.max("top") - F.min("y")).alias("height"),
        F.min_by("font_size", rank).alias("font_size"), F.min_by("font", rank).alias("font_name"),
    )


def decoded_steps(steps: DataFrame, keys: list[str], signs: list[str], order: str = "step", scores: str = "scores") -> DataFrame:
    """The text and mean confidence of a recogniser's scores, step by step.

    Each step's best class counts unless it is 0 or that of the step before; class k is the k-th of `signs`, the one after the last a blank. Of equal
    scores the first is best. Scores outside of 0 to 1 are taken for logits of their step. Groups without any text are left out. Order must be total within the keys.
    """
    line = Window.partitionBy(*keys).orderBy(order)
    top = F.array_max(scores)
    share = F.when((top > 1.0001) | (top < 0), 1 / F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))).otherwise(top)
    rows = steps.select(*keys, order, (F.array_position(F.col(scores), top) - 1).cast("int").alias("best"), share.cast("double").alias("share"))
    rows = rows.withColumn("before", F.lag("best").over(line)).where((F.col("best") > 0) & ~F.col("best").eqNullSafe(F.col("before")))
    sign = F.coalesce(F.get(F.array(*[F.lit(x) for x in [*signs, " "]]), F.col("best") - 1), F.lit(""))
    texts = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), sign.alias("sign")))), lambda x: x["sign"]), "").alias("text"), F.avg("share").alias("confidence"))
    return texts.where("text <> ''")
