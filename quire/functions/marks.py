"""Marks of items and chapters in official documents, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.functions.text import bound, trim
from quire.operators.structure import written_number

#: Consonants in order, plain and circled (fixed values).
JAMO, CIRCLED_JAMO = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ", "㉠㉡㉢㉣㉤㉥㉦㉧㉨㉩㉪㉫㉬㉭"
#: Number formats by the codes of paragraph heads and of automatic numbers (fixed values); other codes are digits.
HEAD_FORMATS = {1: "circled", 2: "roman_upper", 3: "roman_lower", 4: "latin_upper", 5: "latin_lower", 8: "hangul", 9: "circled_hangul", 10: "jamo", 11: "circled_jamo", 12: "written_hangul", 13: "written_hanja"}
SHAPE_FORMATS = {1: "circled", 2: "roman_upper", 3: "roman_lower", 4: "latin_upper", 5: "latin_lower", 6: "hangul", 7: "written_hangul", 8: "written_hanja"}
#: Bullets by depth (fixed values); the second may be ㅇ instead, plans and press releases have * as the third. Deeper items have the last.
BULLETS, SECOND, STAR = ("□", "○", "-", "ㆍ"), "ㅇ", "*"


def _of(n: Column, row: str) -> Column:
    """The 1-based n-th character of the row; beyond it, decimal."""
    return F.when(n.between(1, len(row)), F.substring(F.lit(row), n.cast("int"), F.lit(1))).otherwise(n.cast("string"))


def _written(n: Column, script: str, none: str) -> Column:
    return F.when(n == 0, none).otherwise(written_number(n, script))


def number_text(n: Column, form: str) -> Column:
    """The 1-based n in one of the formats of HEAD_FORMATS; numbers that the format can't say are decimal."""
    said = {
        "circled": lambda: numbers.circled_number(n - 1), "roman_upper": lambda: numbers.roman_numeral(n), "roman_lower": lambda: numbers.roman_numeral(n, False),
        "latin_upper": lambda: numbers.latin_ordinal(n, True), "latin_lower": lambda: numbers.latin_ordinal(n), "hangul": lambda: numbers.hangul_ordinal(n - 1),
        "circled_hangul": lambda: numbers.circled_hangul(n - 1), "jamo": lambda: _of(n, JAMO), "circled_jamo": lambda: _of(n, CIRCLED_JAMO),
    }
    if form.startswith("written_"):
        return _written(n, form[8:], {"written_hangul": "영", "written_hanja": "零"}[form])
    return F.when(n >= 1, said[form]()).otherwise(n.cast("string")) if form in said else n.cast("string")


def coded_number(n: Column, code: Column, formats: dict[int, str] = HEAD_FORMATS) -> Column:
    """number_text() in the format of a code; unknown and null codes are digits."""

    def said(n: Column) -> Column:
        out = F.when(F.lit(False), "")
        for k, form in formats.items():
            out = out.when(code == k, number_text(n, form))
        return out.otherwise(n.cast("string"))

    return bound(n, said)


def expanded(pattern: Column, counters: Column, starts: Column, codes: Column, levels: int = 7) -> Column:
    """^1 to ^7 in the pattern as the number of that level; counters run from 1, 0 and nulls stand for the level's first number; starts default to 1, codes to digits."""

    def said(k: Column) -> Column:
        count, start = F.coalesce(F.get(counters, k), F.lit(0)), F.coalesce(F.get(starts, k), F.lit(1))
        return coded_number(F.when(count > 0, start - 1 + count).otherwise(start), F.get(codes, k))

    levels_from_0 = F.sequence(F.lit(0), F.lit(levels - 1))
    return F.aggregate(levels_from_0, pattern, lambda text, k: F.when(text.contains("^"), F.replace(text, F.concat(F.lit("^"), (k + 1).cast("string")), said(k))).otherwise(text))


def statutory_mark(depth: Column, n: Column) -> Column:
    """The mark of the 0-based n-th item at a depth of 0 to 7, as official letters have it; deeper ones are as 7."""
    number, letter = (n + 1).cast("string"), numbers.hangul_ordinal(n)
    shapes = [("", number, "."), ("", letter, "."), ("", number, ")"), ("", letter, ")"), ("(", number, ")"), ("(", letter, ")"), ("", numbers.circled_number(n), "")]
    out = F.when(F.lit(False), "")
    for k, (a, x, b) in enumerate(shapes):
        out = out.when(depth == k, F.concat(F.lit(a), x, F.lit(b)))
    return out.otherwise(numbers.circled_hangul(n))


def bullet_mark(depth: Column, small_second: bool = False, star_third: bool = False) -> Column:
    """The bullet of a depth from 0, as reports have it."""
    row = [BULLETS[0], SECOND if small_second else BULLETS[1], STAR if star_third else BULLETS[2], BULLETS[3]]
    return F.element_at(F.array(*map(F.lit, row)), (F.least(depth, F.lit(3)) + 1).cast("int"))


def chapter_roman(n: Column) -> Column:
    """A chapter's number in Roman number signs: one sign up to 12, beyond that tens and what is left; empty below 1."""
    sign = lambda k: F.decode(F.unhex(F.hex((F.lit(0x215F) + k).cast("long"))), "UTF-16BE")
    ones = F.element_at(F.array(*map(F.lit, ["", "Ⅰ", "ⅠⅠ", "ⅠⅠⅠ", "Ⅳ", "Ⅴ", "ⅤⅠ", "ⅤⅠⅠ", "ⅤⅠⅠⅠ", "Ⅸ"])), (n % 10 + 1).cast("int"))
    return F.when(n < 1, "").when(n <= 12, sign(n)).otherwise(F.concat(F.repeat(F.lit("Ⅹ"), (n / 10).cast("int")), ones))


def bare_chapter_title(title: Column) -> Column:
    """Without a bullet and a number at its start, so that numbering it again doesn't double them. Of "1.5 x", whose number no point ends, the "1." goes."""
    return trim(F.regexp_replace(F.regexp_replace(title, r"^\s*[□○ㅇㆍ-]\s+", ""), r"^\s*(?:\d+(?:\.\d+)*|[Ⅰ-Ⅻ]+)\s*[.)]\s*", ""))


def dotted_date(day: Column) -> Column:
    """A date as 2024. 3. 9."""
    return F.concat_ws(" ", *[F.concat(f(day).cast("string"), F.lit(".")) for f in (F.year, F.month, F.dayofmonth)])


def has_end_mark(text: Column) -> Column:
    """A text that ends with the word that closes official letters."""
    return trim(text).rlike(r"(^|\s)끝\s*\.\s*$")


def mm_to_units(mm: Column) -> Column:
    """Millimetres in units of 1/7200 inch."""
    return F.floor(mm * 7200 / 25.4 + 0.5).cast("long")
