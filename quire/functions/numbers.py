"""Numbers, dates and numbering marks as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify_date_format(code: Column) -> Column:
    """date, datetime or null for a spreadsheet's number format."""
    bare = F.regexp_replace(code, r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return F.when(bare.rlike("(?i)[hs]") & bare.rlike("(?i)[ymdh]"), "datetime").when(bare.rlike("(?i)[ymd]"), "date")


def serial_to_iso(serial: Column, date1904: Column, kind: Column) -> Column:
    """A spreadsheet's day number as ISO text; null when negative or after the year 9999.

    Days before the 1900 system's day 60, which never was, move up by one; the 1904 system lies 1462 days later.
    """
    days = serial.cast("double") + F.when(date1904, 1462).when(serial < 60, 1).otherwise(0)
    ms = F.floor((days - 25569) * 86400000 + 0.5).cast("long")
    at = F.when((serial >= 0) & (days < 2958466), F.timestamp_millis(ms))
    return F.when(kind == "datetime", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def column_index(ref: Column) -> Column:
    """0-based column of a cell reference like AB123; null if it is none."""
    letters = F.split(F.regexp_extract(ref, r"^([A-Z]+)\d+$", 1), "")
    value = F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return F.when(ref.rlike(r"^[A-Z]+\d+$"), value - 1)


def row_index(ref: Column) -> Column:
    """0-based row of a cell reference."""
    return F.when(ref.rlike(r"^[A-Z]+\d+$"), F.regexp_extract(ref, r"(\d+)$", 1).cast("long") - 1)


#: The fourteen plain initials of Hangul ordinals and the six vowels that follow each other (fixed values: places in the syllable block).
INITIALS, VOWELS = [0, 2, 3, 5, 6, 7, 9, 11, 12, 14, 15, 16, 17, 18], [0, 4, 8, 13, 18, 20]


def hangul_ordinal(n: Column) -> Column:
    """The 0-based n-th of the row 가 나 다 ... 하 거 너 ..."""
    syllables = [chr(0xAC00 + i * 588 + v * 28) for v in VOWELS for i in INITIALS]
    at = F.least((n / len(INITIALS)).cast("int"), F.lit(len(VOWELS) - 1)) * len(INITIALS) + n % len(INITIALS)
    return F.element_at(F.array(*map(F.lit, syllables)), (at + 1).cast("int"))


def circled_number(n: Column) -> Column:
    """The 0-based n-th circled number up to 50, then a number in parentheses."""
    code = F.when(n < 20, 0x2460 + n).when(n < 35, 0x3251 - 20 + n).otherwise(0x32B1 - 35 + n)
    return F.when(n < 50, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")).otherwise(F.concat(F.lit("("), (n + 1).cast("string"), F.lit(")")))


def circled_hangul(n: Column) -> Column:
    """The 0-based n-th of the fourteen circled syllables, then plain ordinals."""
    marks = [chr(0x326E + i) for i in range(14)]
    return F.when(n < 14, F.element_at(F.array(*map(F.lit, marks)), (F.least(n, F.lit(13)) + 1).cast("int"))).otherwise(hangul_ordinal(n))


def roman_numeral(n: Column, upper: bool = True) -> Column:
    """1 to 3999 in Roman numerals, digit by digit; other numbers in decimal."""
    out = []
    for power, (one, five, ten) in ((1000, ("M", "", "")), (100, ("C", "D", "M")), (10, ("X", "L", "C")), (1, ("I", "V", "X"))):
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out.append(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.floor(n / power) % 10 + 1).cast("int")))
    text = F.concat(*out)
    return F.when((n >= 1) & (n <= 3999), text if upper else F.lower(text)).otherwise(n.cast("string"))


def latin_ordinal(n: Column, upper: bool = False) -> Column:
    """1-based n as letters: a ... z, aa, ab ... for up to three letters; other numbers in decimal."""
    start, digit = ord("A" if upper else "a"), lambda x: F.char(F.lit(ord("A" if upper else "a")) + x)
    one, two = n - 1, n - 27
    three = n - 703
    return (
        F.when((n >= 1) & (n <= 26), F.char(F.lit(start) + one))
        .when((n > 26) & (n <= 702), F.concat(digit(F.floor(two / 26)), digit(two % 26)))
        .when((n > 702) & (n <= 18278), F.concat(digit(F.floor(three / 676)), digit(F.floor(three / 26) % 26), digit(three % 26)))
        .otherwise(n.cast("string"))
    )


def to_int32(n: Column) -> Column:
    """An unsigned 32-bit value as a signed one."""
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS as ISO text; missing parts are 01 or 00, null without a year."""
    part = lambda i, none: F.coalesce(F.nullif(F.regexp_extract(text, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?", i), F.lit("")), F.lit(none))
    iso = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    return F.when(text.rlike(r"^(?:D:)?\d{4}"), iso)
