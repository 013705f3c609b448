"""Passes over a document's blocks that depend on what came before: captions, key-value lines, false tables, charts, blanks in cells, and alignment of units.

The passes over blocks are folds, a document at a time.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.compare import _common, text_similarity

#: Caption labels, and the longest caption (fixed values).
_CAPTION = re.compile(r"[<\[(【〈]?\s*(?:표|그림|도표|Table|Figure|Fig\.?)\s*[0-9①-⑮][0-9.\-]*\s*[\])】〉>]?[.:]?\s*", re.I)
MOST_CAPTION = 100
#: Words that begin a key-value line (fixed values).
KEY_WORDS = ("구분", "항목", "종류", "분류", "유형", "대상", "내용", "기간", "금액", "비율", "방법", "절차", "요건", "조건", "근거", "목적", "범위", "기준")
_NOT_PAIR = re.compile(r"[0-9]{1,2}:[0-9]{2}|://|[0-9]+:[0-9]+|[()]")

CAPTIONED = "doc_id long, block_id int, type string, text string, page_number int, caption string"
PAIRED = "doc_id long, block_id int, type string, text string, table_id int, r int, c int"


def caption_blocks(blocks: list[dict]) -> list[dict]:
    """Blocks of one document, captions moved to their tables: the one before a table first, else the one after; each is taken once."""
    out: list[dict] = []
    rest = [dict(b, caption=None) for b in blocks]

    def fits(b: dict | None, table: dict) -> bool:
        text = ((b or {}).get("text") or "").strip()
        same = b is not None and b["type"] == "paragraph" and (b["page_number"] == table["page_number"] or (pd.isna(b["page_number"]) and pd.isna(table["page_number"])))
        return same and 0 < len(text) <= MOST_CAPTION and "\n" not in text and bool(_CAPTION.match(text))

    i = 0
    while i < len(rest):
        b = rest[i]
        if b["type"] == "table":
            if out and fits(out[-1], b):
                b["caption"] = out.pop()["text"].strip()
            elif i + 1 < len(rest) and fits(rest[i + 1], b):
                b["caption"] = rest[i + 1]["text"].strip()
                i += 1
        out.append(b)
        i += 1
    return out


def captions(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_id, type, text, page_number) with the tables' captions, caption paragraphs left out."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        rows = caption_blocks(own.sort_values("block_id").to_dict("records"))
        return pd.DataFrame(rows, columns=["doc_id", "block_id", "type", "text", "page_number", "caption"]).astype({"page_number": "Int32"})

    return blocks.select("doc_id", "block_id", "type", "text", "page_number").groupBy("doc_id").applyInPandas(fold, CAPTIONED)


def _pair(text: str, going: bool) -> tuple[str, str] | None:
    """Key and value of a line; a plain `word: value` counts only once pairs have begun."""
    if re.match(r"\(?(?:" + "|".join(KEY_WORDS) + r")(?:[\s:)]|$)", text):
        key, sep, value = text.partition(":") if ":" in text else text.partition(" ")
        return (key.strip(), value.strip()) if sep else (text, "")
    key, sep, value = text.partition(":")
    return (key.strip(), value.strip()) if going and sep and not _NOT_PAIR.search(text) and re.fullmatch("[가-힣]{2,8}", key.strip()) else None


def pair_tables(blocks: DataFrame) -> DataFrame:
    """Cells (doc_id, table_id, r, c, text) of tables made of two or more consecutive key-value paragraphs; table_id is the first one's block_id."""

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        runs: list[list[tuple[int, str, str]]] = [[]]
        for b in own.sort_values("block_id").to_dict("records"):
            found = _pair((b["text"] or "").strip(), bool(runs[-1])) if b["type"] == "paragraph" else None
            if found:
                runs[-1].append((b["block_id"], *found))
            elif runs[-1]:
                runs.append([])
        rows = [(own["doc_id"].iloc[0], run[0][0], r, c, t) for run in runs if len(run) > 1 for r, (_, *pair) in enumerate(run) for c, t in enumerate(pair)]
        return pd.DataFrame(rows, columns=["doc_id", "table_id", "r", "c", "text"])

    return blocks.select("doc_id", "block_id", "type", "text").groupBy("doc_id").applyInPandas(fold, "doc_id long, table_id int, r int, c int, text string")


def false_tables(grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys of tables that are boxes or lines of text rather than data.

    Tables with a first row of short labels without marks, and something below it, stay. Of the others go: small ones of little text with a third of
    the cells blank or with marks; short ones of up to three rows with marks; up to two rows mostly blank; single rows without a number.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    stats = grid.groupBy(*keys).agg(
        (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count(F.lit(1)).alias("n"), F.count_if(t == "").alias("blank"), (F.sum(F.length(t)) + F.greatest(F.count_if(t != "") - 1, F.lit(0))).alias("chars"),
        F.max(t.rlike("[□■◆○●▶]")).alias("marks"), F.max(t.rlike("ㅇ|<[^>]+>")).alias("signs"), F.max(t.rlike(r"\d{2,}")).alias("numbers"),
        F.min(F.when(F.col("r") == 0, F.length(t).between(1, 12) & ~t.rlike("[□■◆○●▶ㅇ<>]"))).alias("labels"), F.max((F.col("r") > 0) & (t != "")).alias("body"),
    )
    data = "rows >= 2 and cols >= 2 and labels and body"
    box = "rows <= 3 and cols <= 3 and chars <= 200 and (blank >= 0.3 * n or marks or signs)"
    line = "chars <= 200 and ((marks and rows <= 3) or (rows <= 2 and blank > 0.5 * n) or (rows = 1 and not numbers))"
    return stats.where(f"not ({data}) and (({box}) or ({line}))").select(*keys)


CHART = "struct<type:string,categories:array<string>,series:array<struct<name:string,values:array<double>>>>"
#: Lines of a chart that name no series, and types with one series (fixed values).
CHART_KEYS, ONE_SERIES = ("type", "cat", "size", "colors", "point_colors", "title"), ("pie", "doughnut", "donut", "pie3d")


def parse_chart(text: str | None) -> dict | None:
    """A chart's type, categories and series from `key: value` lines; None without a series or with a value that is no number."""
    kind, named, series = "", [], []
    for line in (text or "").split("\n"):
        key, sep, value = re.sub("：", ":", line.strip(), count=1).partition(":")
        key, value = key.strip(), value.strip()
        if not sep or not key or key.startswith("#"):
            continue
        parts = [p.strip() for p in value.split(",") if p.strip()]
        if key.lower() == "type":
            kind = value
        elif key.lower() == "cat":
            named = parts
        elif key.lower() not in CHART_KEYS:
            parts = [p.strip() for p in re.sub(r"([0-9]),(?=[0-9]{3}(?:[^0-9]|$))", r"\1", value).split(",") if p.strip()]
            try:
                series += [{"name": key, "values": [float(p) for p in parts]}] if parts else []
            except ValueError:
                return None
    if not series:
        return None
    series = series[:1] if kind.lower() in ONE_SERIES else series
    n = max(len(named), *(len(s["values"]) for s in series))
    for s in series:
        s["values"] += [0.0] * (n - len(s["values"]))
    return {"type": kind or None, "categories": [named[i] if i < len(named) else f"항목 {i + 1}" for i in range(n)], "series": series}


def charts(text: str | Column) -> Column:
    """parse_chart() of a column."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_chart(t) or {"type": None, "categories": None, "series": None} for t in texts], columns=["type", "categories", "series"])

    return F.pandas_udf(run, CHART)(text)


#: Values that check a box (fixed values).
CHECKED = frozenset(("☑", "✓", "✔", "v", "V", "true", "1", "yes", "o", "O"))


def fill_blanks(text: str | None, values: Mapping[str, str]) -> str | None:
    """Blanks inside a cell filled from values: `일반(  )통`, boxes before a word, `(이름:   )`."""
    plain = lambda x: re.sub(r"[:：\s()（）·]", "", x)

    def bracket(m: re.Match) -> str:
        key = next((k for k in (plain(m[1] + m[2]), plain(m[1])) if k in values), None)
        return m[0] if key is None else f"{m[1]}({values[key]}){m[2]}"

    text = re.sub(r"([가-힣A-Za-z]+)\(\s+\)([가-힣A-Za-z]*)", bracket, text or "")
    text = re.sub(r"□([가-힣A-Za-z]+)", lambda m: "☑" + m[1] if values.get(plain(m[1]), "").strip() in CHECKED else m[0], text)
    return re.sub(r"\(([가-힣A-Za-z]+)[:：]\s+\)", lambda m: f"({m[1]}：{values[plain(m[1])]})" if plain(m[1]) in values else m[0], text)


def align_units(a: list[str], b: list[str], alike: float = 0.4, most: int = 4_000_000) -> list[tuple[int | None, int | None]]:
    """Units of two versions side by side: equal ones by a longest common subsequence, gaps of one length by place, others by likeness."""
    n, m = len(a), len(b)
    if n * m > most:
        head = next((k for k in range(min(n, m)) if a[k] != b[k]), min(n, m))
        tail = next((k for k in range(min(n, m) - head) if a[n - 1 - k] != b[m - 1 - k]), min(n, m) - head)
        exact = [(k, k) for k in range(head)] + [(n - k, m - k) for k in range(tail, 0, -1)]
        alike = 2.0  # between them nothing is compared
    else:
        names = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
        u, v = (pd.Series([names[x] for x in t], dtype="int64").to_numpy() for t in (a, b))
        exact = _common(n, m, u[:, None] == v[None, :])
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for p, q in [*exact, (n, m)]:
        if p - i == q - j:
            out += list(zip(range(i, p), range(j, q), strict=True))
            i, j = p, q
        while i < p and j < q and alike <= 1:
            spare, now = (p - i) - (q - j), text_similarity(a[i], b[j])
            later_a = max((text_similarity(a[k], b[j]) for k in range(i + 1, i + spare + 1)), default=0.0) if spare > 0 else 0.0
            later_b = max((text_similarity(a[i], b[k]) for k in range(j + 1, j - spare + 1)), default=0.0) if spare < 0 else 0.0
            if now >= alike and max(later_a, later_b) <= now:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif spare > 0 or (spare == 0 and now < alike):
                out.append((i, None))
                i += 1
            else:
                out.append((None, j))
                j += 1
        out += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)]
        out += [(p, q)] if p < n and q < m else []
        i, j = p + 1, q + 1
    return out


#: Digits and units of written numbers (fixed values).
DIGITS, UNITS = {"hangul": "일이삼사오육칠팔구", "hanja": "一二三四五六七八九"}, {"hangul": "십백천만", "hanja": "十百千萬"}


def written_number(n: Column, script: str = "hangul") -> Column:
    """1 to 99,999 in words, digit by digit (a one before a unit isn't said); other numbers in decimal."""
    out = []
    for power in range(4, -1, -1):
        digit = (F.floor(n / 10**power) % 10).cast("int")
        said = F.element_at(F.array(F.lit(""), *map(F.lit, DIGITS[script])), digit + 1)
        unit = UNITS[script][power - 1] if power else ""
        out.append(F.when(digit == 0, "").when((digit == 1) & F.lit(power > 0), unit).otherwise(F.concat(said, F.lit(unit))))
    return F.when((n >= 1) & (n <= 99_999), F.concat(*out)).otherwise(n.cast("string"))
