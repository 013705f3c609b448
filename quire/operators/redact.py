"""Masking of personal data, without changing a text's length.

Rules come in an order of precedence; a match that overlaps one of an earlier rule is skipped. Hits carry the rule, the masked text, and place and
length in UTF-16 units, never the data themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_RULES = ("rrn", "phone", "email", "card", "account")
#: Rules by precedence, with their patterns (fixed values).
PATTERNS = {
    "rrn": r"(?<!\d)(\d{6})([-‐‑–—])([1-8]\d{6})(?!\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "card": r"(?<!\d)(\d{4})([- ])(\d{4})\2(\d{4})\2(\d{4})(?!\d)",
    "phone": r"(?<![\d-])(?:(01[016789]|070|02|0[3-6]\d)([-. ]?)(\d{3,4})\2(\d{4})|(1[568]\d{2})([-. ])(\d{4}))(?!\d)",
    "driver": r"(?<![\d-])(\d{2})-(\d{2})-\d{6}-\d{2}(?!-?\d)",
    "account": r"(?<!\d)(?<!\d-)\d{2,6}(?:-\d{2,6}){1,2}-\d{2,8}(?!-?\d)",
    "passport": r"\b([MSRODG])\d{8}(?![0-9A-Za-z])",
}
_COMPILED = {rule: re.compile(pattern, re.ASCII) for rule, pattern in PATTERNS.items()}

RESULT = "text string, hits array<struct<rule:string,masked:string,index:int,length:int>>"


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _valid(rule: str, m: re.Match) -> bool:
    if rule == "rrn":
        return 1 <= int(m[1][2:4]) <= 12 and 1 <= int(m[1][4:6]) <= 31
    if rule == "card":
        return _luhn(re.sub(r"\D", "", m[0]))
    return rule != "account" or 10 <= sum(c.isdigit() for c in m[0]) <= 16


def _shown(rule: str, m: re.Match) -> list[tuple[int, int]]:
    """The parts of a match that stay readable, as spans of the text; separators of numbers stay as well."""
    if rule == "rrn":
        return [m.span(1)]
    if rule == "email":
        return [(m.start(), m.start() + 1), (m[0].index("@") + m.start(), m.end())]
    if rule == "card":
        return [m.span(1), m.span(5)]
    if rule == "phone":
        return [m.span(1), m.span(4)] if m[1] is not None else [m.span(5)]
    if rule == "driver":
        return [m.span(1), m.span(2)]
    return [(m.start() + m[0].rindex("-"), m.end())] if rule == "account" else [m.span(1)]


def _masked(rule: str, m: re.Match, mark: str) -> str:
    shown = _shown(rule, m)
    keep = lambda i, c: any(a <= i < b for a, b in shown) or (rule != "email" and not c.isalnum())
    return "".join(c if keep(m.start() + i, c) else mark for i, c in enumerate(m[0]))


def _wide(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def redact_text(text: str | None, rules: Sequence[str] = DEFAULT_RULES, mark: str = "●") -> tuple[str | None, list[dict]]:
    """The masked text and its hits by place."""
    taken: list[tuple[int, int, str, str]] = []
    for rule, pattern in _COMPILED.items():
        if rule in rules and text:
            for m in pattern.finditer(text):
                if _valid(rule, m) and not any(m.start() < b and m.end() > a for a, b, *_ in taken):
                    taken.append((*m.span(), rule, _masked(rule, m, mark)))
    out, at, hits = [], 0, []
    for a, b, rule, masked in sorted(taken):
        out += [text[at:a], masked]
        hits.append({"rule": rule, "masked": masked, "index": _wide(text[:a]), "length": _wide(text[a:b])})
        at = b
    return (text if not taken else "".join(out) + text[at:]), hits


def redact_markdown(text: str | None, rules: Sequence[str] = DEFAULT_RULES, mark: str = "●") -> tuple[str | None, list[dict]]:
    """redact_text() by lines, of which those with embedded images stay."""
    if text is None:
        return None, []
    lines, hits, at = [], [], 0
    for line in text.split("\n"):
        masked, found = (line, []) if "data:image/" in line else redact_text(line, rules, mark)
        hits += [h | {"index": h["index"] + at} for h in found]
        lines.append(masked)
        at += _wide(line) + 1
    return "\n".join(lines), hits


def redacted(text: str | Column, rules: Sequence[str] = DEFAULT_RULES, mark: str = "●", markdown: bool = True) -> Column:
    """The struct (text, hits) of a column."""
    if len(mark) != 1 or mark > "￿" or re.fullmatch("[0-9A-Za-z]", mark):
        raise ValueError("the mark must be one character that is neither a letter nor a digit")
    if unknown := set(rules) - set(PATTERNS):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    one: Callable = redact_markdown if markdown else redact_text

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, rules, mark) for t in texts], columns=["text", "hits"])

    return F.pandas_udf(run, RESULT)(text)
