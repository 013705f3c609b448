"""Widths of text and line breaks in the way of a word processor's page."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advances of ASCII from the blank on, in thousandths of the font size (fixed values: a font's metrics).
ASCII_WIDTHS = (
    300, 320, 320, 610, 610, 830, 724, 320, 320, 320, 550, 550, 320, 550, 320, 550, 550, 550, 550, 550, 550, 550, 550, 550, 550, 550, 320, 320, 550, 550, 550, 550,
    830, 706, 605, 685, 719, 627, 617, 683, 734, 305, 315, 660, 605, 839, 734, 732, 603, 705, 660, 627, 664, 731, 706, 910, 705, 705, 626, 320, 550, 320, 550, 550,
    320, 569, 597, 552, 597, 536, 356, 562, 635, 287, 288, 582, 287, 907, 635, 588, 597, 579, 478, 496, 356, 635, 563, 720, 542, 543, 486, 320, 320, 320, 550,
)
#: Advances of single signs (fixed values).
SIGN_WIDTHS = {
    0xA0: 300, 0xA3: 568, 0xA5: 707, 0xA7: 498, 0xAB: 440, 0xAC: 564, 0xB0: 291, 0xB1: 798, 0xB6: 606, 0xB7: 320, 0xBB: 440, 0xD7: 617, 0xF7: 678, 0x2013: 625, 0x2014: 875, 0x2015: 875,
    0x2018: 320, 0x2019: 320, 0x201C: 480, 0x201D: 480, 0x2020: 558, 0x2021: 438, 0x2025: 640, 0x2026: 960, 0x2030: 988, 0x2032: 335, 0x2033: 474, 0x203B: 770, 0x20AC: 656, 0x261C: 1012, 0x261E: 1012,
}
#: Ranges with one advance (fixed values).
RANGE_WIDTHS = (
    (0x1100, 0x11FF, 970), (0x2160, 0x2183, 970), (0x2190, 0x22FF, 970), (0x2460, 0x24FF, 970), (0x25A0, 0x26FF, 970), (0x2E80, 0x3007, 970), (0x3008, 0x3011, 500), (0x3012, 0x3013, 970),
    (0x3014, 0x301B, 500), (0x301C, 0x4DFF, 970), (0x4E00, 0x9FFF, 1000), (0xA000, 0xF8FF, 970), (0xF900, 0xFAFF, 1000), (0xFB00, 0x10FFFF, 970),
)
#: Signs that begin no line, and that end none (fixed values).
NO_START, NO_END = frozenset("!%),.:;?]}¢°′″℃〉》」』】〕！％），．：；？］｝￠～…·、。〃"), frozenset("$([{£¥〈《「『【〔＄（［｛￦")
BLANK = 500
OTHER = 550
#: Fonts whose characters are all half or full width (fixed values).
FIXED_PITCH = ("굴림체", "돋움체", "바탕체", "궁서체")


def is_fixed_pitch(font: Column) -> Column:
    """Whether a font's widths are those of fixed_pitch; false for null."""
    return F.coalesce(F.trim(font).isin(*FIXED_PITCH), F.lit(False))


def widths(text: str, fixed_pitch: bool = False, blank: int = BLANK) -> np.ndarray:
    """Each character's advance in thousandths of the font size."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if fixed_pitch:
        out = np.where(codes < 0x80, 500, 1000)
    else:
        out = np.full(len(codes), OTHER)
        for a, b, w in RANGE_WIDTHS:
            out[(codes >= a) & (codes <= b)] = w
        for code, w in SIGN_WIDTHS.items():
            out[codes == code] = w
        ascii_ = (codes >= 0x20) & (codes <= 0x7E)
        out[ascii_] = np.array(ASCII_WIDTHS)[codes[ascii_] - 0x20]
    out[codes == 0x20] = blank
    return out


def text_width(text: str | None, height: float, ratio: float = 100, spacing: float = 0, fixed_pitch: bool = False, blank: int = BLANK) -> float:
    """Width at a font height, horizontal scale and letter spacing (both in percent)."""
    return float(widths(text or "", fixed_pitch, blank).sum()) * (1 + spacing / 100) / 1000 * height * ratio / 100


def measured(text: str | Column, height: float, ratio: float = 100, spacing: float = 0) -> Column:
    """text_width() of a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text_width(t, height, ratio, spacing))

    return F.pandas_udf(run, "double")(text)


def wrap(text: str, first: float, rest: float, height: float, ratio: float = 100, by_word: bool = True, spacing: float = 0, fixed_pitch: bool = False) -> tuple[list[int], float]:
    """Starts of the lines (in characters) and the last line's width.

    Words move to the next line whole (or characters, not by_word); blanks at a line's end take no room; a sign that may not begin a line takes the
    character before it along, one that may not end a line goes along; what fits no line is cut anywhere.
    """
    w = widths(text, fixed_pitch) * (1 + spacing / 100) * height * ratio / 100_000
    upto = np.append(0, np.cumsum(w))
    starts, room, used = [0], first, 0.0

    def turn(at: int) -> None:
        """Starts a line at this place, or a little before."""
        nonlocal room, used
        cut = at
        if at < len(text) and text[at] in NO_START and cut - 1 > starts[-1] and text[cut - 1] != " ":
            cut -= 1
        while cut - 1 > starts[-1] and text[cut - 1] in NO_END:
            cut -= 1
        cut = cut if cut > starts[-1] else at
        starts.append(cut)
        room, used = rest, float(upto[at] - upto[cut])

    for m in re.finditer(" +|[^ ]+" if by_word else " +|[^ ]", text):
        a, b = m.span()
        own = float(upto[b] - upto[a])
        if text[a] == " " or used + own <= room + 0.5:
            used += own
        elif used == 0 or own > rest + 0.5:
            for k in range(a, b):
                if used + w[k] > room + 0.5 and used > 0:
                    turn(k)
                used += float(w[k])
        else:
            turn(a)
            used += own
    return starts, used


def fit_ratio(text: str, first: float, rest: float, height: float, base: int, least: int) -> int | None:
    """The largest scale under base that saves a line, or None."""
    lines = len(wrap(text, first, rest, height, base)[0])
    return next((r for r in range(base - 1, least - 1, -1) if len(wrap(text, first, rest, height, r)[0]) < lines), None) if lines > 1 else None


def wrapped_lines(text: str | Column, first: float, rest: float, height: float, ratio: float = 100, by_word: bool = True) -> Column:
    """The number of lines of a column's texts."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(wrap(t or "", first, rest, height, ratio, by_word)[0]))

    return F.pandas_udf(run, "int")(text)


def column_widths(needs: list[float], total: int, least: float = 0.06, most: float = 0.8) -> list[int]:
    """Whole positive widths that add up to total: columns in proportion to what they need, each within 6 and 80 percent."""
    n = len(needs)
    if not n:
        return []
    need = np.maximum(np.array(needs, float), 1e-9)
    low, high = min(least, 1 / n) * total, max(most, 1 / n) * total
    share = need / need.sum() * total
    for _ in range(n):
        fixed = (share <= low) | (share >= high)
        share = np.clip(share, low, high)
        if abs(left := total - share.sum()) < 1e-9 or fixed.all():
            break
        share[~fixed] += left * share[~fixed] / share[~fixed].sum()
    out = np.maximum(1, np.floor(share)).astype(int)
    for i in np.argsort(out - share, kind="stable")[: max(0, total - int(out.sum()))]:
        out[i] += 1
    out[int(out.argmax())] += total - int(out.sum())
    return out.tolist()
