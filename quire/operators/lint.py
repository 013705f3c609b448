"""Notation rules for official texts, line by line; fenced code is skipped."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = r"[\s   -     　﻿]"
_NW = r"[^\s   -     　﻿]"
#: Rule, severity, pattern, advice (fixed values: the notation that the rules of official writing ask for).
RULES = (
    ("DATE_NO_SPACE", "error", r"\b\d{4}\.\d{1,2}\.\d{1,2}\.?", "2025. 1. 6."),
    ("DATE_ZERO_PAD", "error", rf"\b\d{{4}}\.{_W}*0\d\.|\b\d{{4}}\.{_W}*\d{{1,2}}\.{_W}*0\d", "2025. 1. 6."),
    ("DATE_2DIGIT_YR", "error", rf"(?<!\d)['’]\d{{2}}\.{_W}*\d", "2025. 1. 6."),
    ("DATE_NO_END_DOT", "warning", rf"\b\d{{4}}\.{_W}\d{{1,2}}\.{_W}\d{{1,2}}(?!{_W}*[.\d(])", "2025. 1. 6."),
    ("TIME_AMPM", "error", rf"(오전|오후|아침|밤|낮){_W}*\d{{1,2}}{_W}*시", "09:00, 15:30"),
    ("TIME_24H", "warning", rf"(?<!\d)24{_W}*시(?!각)", "18:00"),
    ("TIME_COLON_SP", "error", rf"\b\d{{1,2}}{_W}+:{_W}*\d{{2}}\b|\b\d{{1,2}}:{_W}+\d{{2}}\b", "13:20"),
    ("MONEY_CHEONWON", "error", rf"\d+{_W}*천{_W}*원", "345,000원"),
    ("MONEY_GEUM_SP", "warning", rf"금{_W}+\d", "금113,560원"),
    ("BUNIM_COLON", "error", rf"붙{_W}*임{_W}*:", "붙임  계획서 1부."),
    ("KKAJI_DUP", "error", r"[∼~～][^\n]{0,20}?까지", "2. 20.∼2. 24."),
    ("FOREIGN_FIRST", "warning", rf"\b[A-Z]{{2,5}}{_W}*\([가-힣]", "업무 협약(MOU)"),
    ("COLON_SPACE", "warning", rf"{_NW}{_W}+:(?!//)|{_NW}:(?!//)(?!\d){_NW}", "원장: 김갑동"),
    ("AI_EM_DASH", "warning", r"[—–―]", "·"),
    ("AI_BOLD_OVERUSE", "warning", r"(?:\*\*[^*\n]+\*\*[^*\n]*){3}", "**"),
)
_COMPILED = [(code, severity, re.compile(pattern, re.ASCII), advice) for code, severity, pattern, advice in RULES]
_FENCE = re.compile(r"\s*(```|~~~)")

FINDING = "array<struct<line:int,match:string,rule:string,severity:string,suggest:string>>"


def prose_lines(text: str) -> list[tuple[int, str]]:
    """Lines with their numbers, without fences and what they enclose; a fence ends at the next one of its kind."""
    kind, out = "", []
    for n, line in enumerate(re.split(r"\r?\n", text), 1):
        if m := _FENCE.match(line):
            kind = m[1][0] if not kind else "" if m[1][0] == kind else kind
        elif not kind:
            out.append((n, line))
    return out


def lint_text(text: str | None) -> list[dict]:
    """All findings, by line, then by rule, then by place."""
    return [
        {"line": n, "match": m[0].strip(), "rule": code, "severity": severity, "suggest": advice}
        for n, line in prose_lines(text or "") for code, severity, pattern, advice in _COMPILED for m in pattern.finditer(line)
    ]


def linted(text: str | Column) -> Column:
    """The findings of a column's texts."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lint_text)

    return F.pandas_udf(run, FINDING)(text)


def findings(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, match, rule, severity, suggest)."""
    return texts.select(*keys, F.explode(linted(text)).alias("f")).select(*keys, "f.*")


def summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, errors)."""
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "error").alias("errors"))
