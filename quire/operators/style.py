"""Style rules for outline texts: lines are sorted by what they are, then judged by the rules for that kind."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.lint import _FENCE

#: Presets whose texts are outlines (fixed values).
OUTLINE_PRESETS = ("gaejosik", "report", "plan")
#: Longest item, conclusion and lead; shortest lead that is judged (fixed values).
ITEM, CONCLUSION, LEAD, LEAST_LEAD = 70, 60, 140, 20
#: Words of value and abstraction that make a contrast rhetoric (fixed values).
ABSTRACT = (
    "사람", "마음", "본질", "전환", "태도", "문화", "철학", "가치", "정신", "관계", "신뢰", "과정", "질문", "이야기", "경험", "시간", "공간", "연결", "변화", "미래", "시작", "용기", "의지", "방법", "자세", "의식", "역량",
)
#: Rule, severity, kinds of lines (empty: all), pattern in the text without quotations (fixed values).
RULES = (
    ("DA_ENDING", "error", ("item", "sub", "concl", "para"), r"[가-힣]다\.?$"),
    ("GEOSIDA", "warning", ("item", "sub", "concl", "para"), r"것(?:이다|임)\.?$"),
    ("DEONTIC", "error", (), r"(?:해야|하여야|되어야|돼야|필요가 있)\s*(?:한다|함|합니다|하겠음)\.?$|할 것\.?$"),
    ("QUESTION_EXCLAIM", "error", ("dae", "item", "sub", "concl", "para"), r"[?!？！]"),
    ("COUPLET", "warning", ("dae", "item", "para"), r"[은는이가]\s*[^,]{2,15},\s*[^,]{2,15}[은는이가]\s*[^,]{2,15}$"),
)
_RULES = [(code, severity, kinds, re.compile(pattern)) for code, severity, kinds, pattern in RULES]
_CONTRAST = re.compile(r"(?:아니라|아닌|아니고|아니며)\s*,?\s*([가-힣]{1,12})")
_LEAD_END = re.compile(r"(?:하고자|하려|고자)\s*함\.?$")
_DATE = re.compile(r"[0-9]{4}년\s*[0-9]{1,2}월")
#: What begins a line of each kind (fixed values).
_KINDS = (("lead", r">"), ("concl", r"(?:⇒|=>|➡|→)\s*"), ("note", r"※\s*|\*\s+"), ("dae", r"□"), ("item", r"[○❍ㅇ◦]"))
_BEGINS = [(kind, re.compile(pattern)) for kind, pattern in _KINDS]
_LIST = re.compile(r"(?:[-•ㆍ·]|[0-9]+[.)])\s+(.*)$")

FINDING = "array<struct<line:int,kind:string,rule:string,severity:string,match:string>>"


def line_kind(line: str) -> tuple[str, str] | None:
    """A line's kind and its text; None for blank lines, headings, tables, pictures and rules."""
    bare = line.strip()
    if not bare or bare.startswith(("#", "|", "![")) or re.fullmatch(r"[-=*_]{3,}", bare):
        return None
    for kind, begin in _BEGINS:
        if m := begin.match(bare):
            return kind, bare[m.end() :].strip()
    if m := _LIST.match(bare):
        return ("sub" if len(line) - len(line.lstrip()) >= 2 else "item"), m[1].strip()
    return "para", bare


def _plain(text: str) -> str:
    return re.sub(r"\*\*|__|~~|`", "", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)).strip()


def _unquoted(text: str) -> str:
    return re.sub(r"\([^)]{0,80}\)", "", re.sub("[“\"'‘][^”\"'’]{0,80}[”\"'’]", "", text))


def _judge_line(line: int, kind: str, text: str) -> list[tuple]:
    own = _unquoted(text)
    out = [(line, kind, code, severity, text) for code, severity, kinds, pattern in _RULES if (not kinds or kind in kinds) and pattern.search(own)]
    for m in _CONTRAST.finditer(own):
        rhetoric = any(w in m[1] for w in ABSTRACT)
        out.append((line, kind, "RHETORIC_CONTRAST" if rhetoric else "CONTRAST_CHECK", "error" if rhetoric else "warning", m[0].strip()))
    if kind == "item" and len(text) > ITEM:
        out.append((line, kind, "ITEM_LONG", "warning", text))
    if kind == "concl" and len(text) > CONCLUSION:
        out.append((line, kind, "CONCL_LONG", "warning", text))
    if _DATE.search(text):
        out.append((line, kind, "DATE_KOREAN", "warning", text))
    return out


def _judge_lead(lead: list[tuple[int, str]]) -> list[tuple]:
    text = " ".join(t for _, t in lead).strip()
    if len(text) < LEAST_LEAD:
        return []
    out = [] if _LEAD_END.search(text) else [(lead[0][0], "lead", "LEAD_ENDING", "warning", text)]
    return out + ([(lead[0][0], "lead", "LEAD_LONG", "warning", text)] if len(text) > LEAD or text.count(".") > 1 else [])


def lint_style(text: str | None) -> list[dict]:
    """All findings by line. Front matter and fenced code are skipped; consecutive quoted lines are one lead, judged as a whole."""
    found, lead, fence, front = [], [], "", False
    for n, line in enumerate(re.split(r"\r?\n", text or ""), 1):
        if line.strip() == "---" and (front or n <= 3):
            front = not front
            continue
        if front:
            continue
        if m := _FENCE.match(line):
            fence = m[1][0] if not fence else "" if m[1][0] == fence else fence
            continue
        if fence:
            continue
        kind, body = line_kind(line) or (None, "")
        if kind == "lead":
            lead.append((n, _plain(body)))
            continue
        found += _judge_lead(lead) if lead else []
        lead = []
        if kind and _plain(body):
            found += _judge_line(n, kind, _plain(body))
    found += _judge_lead(lead) if lead else []
    return [{"line": line, "kind": kind, "rule": rule, "severity": severity, "match": match[:60]} for line, kind, rule, severity, match in found]


def findings(texts: DataFrame, keys: list[str], text: str | Column = "text") -> DataFrame:
    """(keys, line, kind, rule, severity, match)."""

    def run(column: pd.Series) -> pd.Series:
        return column.map(lint_style)

    return texts.select(*keys, F.explode(F.pandas_udf(run, FINDING)(text)).alias("f")).select(*keys, "f.*")
