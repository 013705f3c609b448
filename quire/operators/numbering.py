"""Counters of numbered paragraphs in seven levels, and marks of nested items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quire.functions import marks
from quire.operators.folding import folded

#: Levels of a numbering (fixed value).
LEVELS = 7
#: Depths that item_marks() tells apart.
DEPTHS = 16


def advance(state: dict, numbering: int | None, level: int | None) -> list[int]:
    """The counters after a paragraph of this numbering and level.

    A numbering goes on where it last stood. A new one takes over the counters above its level from the paragraph before. Numbering 0 is not kept:
    when it comes back it is new. Null numberings are 0, null levels 0; levels out of range are the nearest in range.
    """
    numbering, level = numbering or 0, min(max(level or 0, 0), LEVELS - 1)
    kept, last = state.setdefault("kept", {}), state.get("last", (0, [0] * LEVELS))
    if numbering == last[0]:
        own = last[1]
    else:
        own = kept.get(numbering) or last[1][:level] + [0] * (LEVELS - level)
    own = [*own[:level], own[level] + 1, *[0] * (LEVELS - 1 - level)]
    state["last"] = numbering, own
    if numbering:
        kept[numbering] = own
    return own


def paragraph_counters(blocks: DataFrame, keys: list[str], order: list[str], numbering: str = "numbering", level: str = "level") -> DataFrame:
    """blocks with `counters`, the seven counters at each numbered paragraph, in order within the keys."""
    return folded(blocks, keys, order, [numbering, level], dict, advance, "counters", ArrayType(IntegerType()), pa.list_(pa.int32()))


def item_marks(items: DataFrame, keys: list[str], order: list[str], depth: str = "depth", kind: str = "statutory", keep_single: bool = False, small_second: bool = False, star_third: bool = False) -> DataFrame:
    """items with `place`, each one's 0-based place among its siblings, and `mark`.

    Siblings are items of one depth without a shallower one between them. Statutory marks count; an item without siblings has none (empty)
    unless keep_single; bullets go by depth alone. Null depths are 0, depths out of range the nearest in range. Order must be total within the keys.
    """
    line = Window.partitionBy(*keys).orderBy(*order)
    level, at, parent, count = "__depth", "__at", "__parent", "__count"
    rows = items.withColumn(level, F.greatest(F.lit(0), F.least(F.lit(DEPTHS - 1), F.coalesce(F.col(depth), F.lit(0)))).cast("int")).withColumn(at, F.row_number().over(line))
    # the last shallower item, for each depth there may be; the row's own depth picks
    above = [F.coalesce(F.max(F.when(F.col(level) < d, F.col(at))).over(line), F.lit(0)) for d in range(DEPTHS)]
    rows = rows.withColumn(parent, F.element_at(F.array(*above), F.col(level) + 1))
    siblings = Window.partitionBy(*keys, level, parent)
    rows = rows.withColumn("place", F.row_number().over(siblings.orderBy(at)) - 1).withColumn(count, F.count(F.lit(1)).over(siblings))
    if kind == "bullets":
        mark = marks.bullet_mark(F.col(level), small_second, star_third)
    else:
        mark = F.when((F.col(count) > 1) | F.lit(keep_single), marks.statutory_mark(F.col(level), F.col("place"))).otherwise("")
    return rows.withColumn("mark", mark).drop(level, at, parent, count)
