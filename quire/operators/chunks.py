"""Structure-preserving chunks: every piece of text with the path of headings and list items above it.

The path is a fold over a document's blocks in order, so each document is one group; documents are spread over all tasks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

#: Marks that begin list items (fixed values: bullets, numbers, syllables, circled signs).
_ITEM = re.compile(r"(?:[□■◇◆○◎●◦ㅇ•▪▸▶※-]|[0-9]{1,3}[.)]|[가나다라마바사아자차카타파하][.)]|\([가나다라마바사아자차카타파하0-9]{1,3}\)|[①-⑳㉮-㉻㈎-㈛])\s")

CHUNK = "doc_id long, chunk_no int, chunk_id string, type string, breadcrumb array<string>, text string, page int, first_block int, last_block int"


def block_markdown(kind: str, text: str, level: int | None, depth: int | None) -> str:
    """A block in markdown; blank if it shows nothing."""
    bare = text.strip()
    if kind == "separator":
        return "---"
    if not bare:
        return ""
    if kind == "heading":
        return "#" * min(level or 2, 6) + " " + bare
    if kind == "list":
        return "  " * (depth or 0) + (bare if re.match(r"[0-9]+[.)]\s|[-*]\s", bare) else "- " + bare)
    return bare


def _value(x: object) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


class _Path:
    """The headings and list items above the next block."""

    def __init__(self) -> None:
        self.headings: list[tuple[int, str]] = []
        self.items: list[tuple[int, str]] = []

    def names(self) -> list[str]:
        return [t for _, t in self.headings + self.items]

    @staticmethod
    def leave(stack: list[tuple[int, str]], rank: int) -> None:
        """Drops what is as deep or deeper."""
        while stack and stack[-1][0] >= rank:
            stack.pop()


def fold_blocks(blocks: list[dict], merge: bool) -> list[dict]:
    """Chunks of one document's blocks. merge: runs of text blocks under one path become one chunk."""
    path, out, run = _Path(), [], None
    for b in blocks:
        kind, text = b["type"], b["text"] or ""
        level, depth, page = (_value(b.get(c)) for c in ("level", "list_depth", "page_number"))
        shown = block_markdown(kind, text, level, depth)
        if not shown:
            continue
        chunk = {"type": "text", "parts": [shown], "page": page, "first_block": b["block_id"], "last_block": b["block_id"]}
        if kind == "heading":
            rank = min(level or 2, 6)
            path.items.clear()
            path.leave(path.headings, rank)
            out.append(chunk | {"type": "heading", "breadcrumb": path.names()})
            path.headings.append((rank, text.strip()))
            run = None
        elif kind == "table":
            out.append(chunk | {"type": "table", "breadcrumb": path.names()})
            run = None
        else:
            if depth is None and (kind == "list" or (kind == "paragraph" and _ITEM.match(text.strip()))):
                depth = 0
            if depth is not None:
                path.leave(path.items, depth)
            crumb = path.names()
            if depth is not None:
                path.items.append((depth, text.strip()))
            if merge and run is not None and run["breadcrumb"] == crumb:
                run["parts"].append(shown)
                run["last_block"] = b["block_id"]
                run["page"] = page if run["page"] is None else run["page"]
            else:
                run = chunk | {"breadcrumb": crumb}
                out.append(run)
    return out


def chunks(blocks: DataFrame, granularity: str = "section") -> DataFrame:
    """Chunks of blocks (doc_id, block_id, type, text, level, list_depth, page_number; tables with their markdown as text).

    granularity: `section` joins consecutive text under one path, `block` makes each block a chunk.
    """
    if granularity not in ("section", "block"):
        raise ValueError("granularity is section or block")

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        rows = fold_blocks(own.sort_values("block_id").to_dict("records"), granularity == "section")
        doc = own["doc_id"].iloc[0]
        done = [
            (doc, n, f"c{n:04d}", c["type"], c["breadcrumb"], "\n\n".join(c["parts"]), c["page"], c["first_block"], c["last_block"])
            for n, c in enumerate(rows, 1)
        ]
        return pd.DataFrame(done, columns=[c.split(" ")[0] for c in CHUNK.split(", ")]).astype({"page": "Int32"})

    wanted = [c for c in ("doc_id", "block_id", "type", "text", "level", "list_depth", "page_number") if c in blocks.columns]
    return blocks.select(*wanted).groupBy("doc_id").applyInPandas(fold, CHUNK)
