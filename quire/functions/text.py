"""Text functions as Spark columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace beyond ASCII that counts as blank (fixed values): no-break, ogham, typographic, line and paragraph, narrow, mathematical, ideographic, byte-order mark.
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f names it; f can't use Python."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trim(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trim(F.regexp_replace(text, f"{WHITE}+", " "))


def strip_control(text: Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]", "")


def length16(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def join_spaced_syllables(text: Column) -> Column:
    """Short texts (30 characters at most) of three or more tokens, of which 70 % are single Hangul characters, without their blanks."""
    tokens = F.split(text, " ")
    lone = F.filter(tokens, lambda t: t.rlike(r"^[\x{AC00}-\x{D7AF}\x{3131}-\x{318E}]$"))
    return F.when((F.length(text) <= 30) & (F.size(tokens) >= 3) & (F.size(lone) >= 0.7 * F.size(tokens)), F.array_join(tokens, "")).otherwise(text)


#: Names of drawn objects whose generated description lines are dropped (fixed values).
OBJECT_NAMES = (
    "사각형", "직사각형", "정사각형", "원", "타원", "삼각형", "이등변 삼각형", "직각 삼각형", "선", "직선", "곡선", "화살표", "굵은 화살표", "이중 화살표", "오각형", "육각형",
    "팔각형", "별", "[4-8]점별", "십자", "십자형", "구름", "구름형", "마름모", "도넛", "평행사변형", "사다리꼴", "부채꼴", "호", "반원", "물결", "번개", "하트", "빗금",
    "블록 화살표", "수식", "표", "그림", "개체", r"그리기\s?개체", r"묶음\s?개체", "글상자", r"수식\s?개체", r"OLE\s?개체",
)


def sanitize(text: Column) -> Column:
    """Without supplementary private-use characters and generated object descriptions, blanks squeezed, spaced-out syllables joined."""
    text = F.regexp_replace(text, r"[\x{F0000}-\x{FFFFD}]", "")
    text = F.regexp_replace(text, rf"(?m)^(?:모서리가 둥근 |둥근 )?(?:{'|'.join(OBJECT_NAMES)})\s?입니다\.?$", "")
    return join_spaced_syllables(trim(F.regexp_replace(text, " {2,}", " ")))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal texts, 0 if one is empty."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def normalized_similarity(a: Column, b: Column) -> Column:
    """similarity() of the squeezed texts."""
    return similarity(squeeze(a), squeeze(b))


def summarize(text: Column, most: int = 80) -> Column:
    """White space squeezed; cut to `most` characters with dots at the end."""
    text = squeeze(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def cap_response(text: Column, most: int = 200_000) -> Column:
    """At most `most` characters, with a notice where text was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n... (cut)"))).otherwise(text)


def sanitize_href(href: Column) -> Column:
    """The link with parentheses percent-encoded if its scheme is safe, else null."""
    safe = F.regexp_replace(F.regexp_replace(trim(href), r"\(", "%28"), r"\)", "%29")
    return F.when(trim(href).rlike(r"(?i)^(?:https?:|mailto:|tel:|#)"), safe)


def is_path_traversal(path: Column) -> Column:
    """NUL, a parent segment, an absolute path or a drive letter."""
    return path.rlike(r"\x00|(?:^|[/\\])\.\.(?:[/\\]|$)|^[/\\]|^[A-Za-z]:")


def contains_inline_math(text: Column) -> Column:
    """An unescaped $...$ whose inside neither starts nor ends with white space."""
    return text.rlike(r"(?<![\\$])\$(?=[^\s$])[^$\n]*(?<=[^\s\\])\$(?!\d)")


def unescape_gfm(text: Column) -> Column:
    """Without the backslashes before ~ * _ and back quotes."""
    return F.regexp_replace(text, r"\\([~*_`])", "$1")


def strip_doctype(xml: Column) -> Column:
    """Without byte-order mark and document type."""
    return F.regexp_replace(F.regexp_replace(xml, r"^\x{FEFF}", ""), r"(?i)<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "")


def is_private_ip(host: Column) -> Column:
    """Private, shared, loopback and link-local addresses of both kinds."""
    v4 = r"(?:0|10|127)\.\d+\.\d+\.\d+|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+"
    return F.lower(host).rlike(rf"^(?:(?:::ffff:)?(?:{v4})|::1?|f[cd][0-9a-f]{{2}}:.*|fe[89ab][0-9a-f]:.*)$")


#: Private-use characters of symbol fonts, from U+F020 on, and what they show (fixed values).
SYMBOLS = {
    0xF06C: "●", 0xF06D: "●", 0xF06E: "■", 0xF06F: "□", 0xF070: "□", 0xF071: "□", 0xF072: "□", 0xF073: "⬧", 0xF074: "⧫", 0xF075: "◆", 0xF076: "❖", 0xF077: "⬥",
    0xF09E: "·", 0xF09F: "•", 0xF0A0: "·", 0xF0A1: "⚪", 0xF0A2: "○", 0xF0A3: "○", 0xF0A4: "◉", 0xF0A5: "◎", 0xF0A7: "▪", 0xF0A8: "◻", 0xF0AA: "✦", 0xF0AB: "★",
    0xF0AC: "✶", 0xF0AD: "✴", 0xF0AE: "✹", 0xF045: "☜", 0xF046: "☞", 0xF047: "☝", 0xF048: "☟", 0xF0FB: "✗", 0xF0FC: "✔", 0xF0FD: "☒", 0xF0FE: "☑", 0xF0E8: "➔",
    0xF0EF: "⇦", 0xF0F0: "⇨", 0xF0F1: "⇧", 0xF0F2: "⇩", 0xF022: "✂", 0xF036: "⌛", 0xF04A: "☺", 0xF04E: "☠", 0xF052: "☼", 0xF054: "❄", 0xF058: "✠", 0xF059: "✡",
}
#: The same for the supplementary plane (fixed values); U+F02B1 to U+F02C4 are the boxed numbers 1 to 20.
SUPPLEMENTARY = {
    0xF003B: "↓", 0xF02EF: "·", 0xF0854: "《", 0xF0855: "》", 0xF00DA: "▸", 0xF080F: "━", 0xF0827: "■", 0xF03C5: "□", 0xF012B: "(인)", 0xF02FC: "►", 0xF031C: "■", 0xF03A0: "↵",
    0xF03EF: "한", 0xF03F0: "글", 0xF03F1: "과", 0xF03F2: "컴", 0xF03F3: "퓨", 0xF03F4: "터",
}
BOXED = 0xF02B1


def map_private(text: Column) -> Column:
    """Private-use characters as the standard ones they show; those not known stay. Null stays null."""
    shown = SYMBOLS | SUPPLEMENTARY | {BOXED + i: chr(0x2460 + i) for i in range(20)}
    single = {k: v for k, v in shown.items() if len(v) == 1}
    text = F.translate(text, "".join(map(chr, single)), "".join(single.values()))
    for code, value in shown.items():
        if code not in single:
            text = F.replace(text, F.lit(chr(code)), F.lit(value))
    return text


#: How an item's marker begins a line, and a line that is nothing but an article's header (fixed patterns).
MARKER = r"^(?:[가-힣ㄱ-ㅎ][.)]|\d+[.)]|\([가-힣ㄱ-ㅎ\d]+\)|[○●※▶▷◆◇■□★☆\-·]\s|제\d+[조항호장절])"
HEADER = r"^제\d+[조항호장절](?:\([^)]*\))?(?:\s+\S+){0,7}$"
_BLANKS = " \t\n\v\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def starts_with_marker(line: Column) -> Column:
    """Whether a line begins with an item's marker."""
    return F.regexp_replace(line, f"^{WHITE}+", "").rlike(MARKER)


def is_standalone_header(line: Column) -> Column:
    """Whether a line is an article's header with a few words at most."""
    return trim(line).rlike(HEADER)


def _joint(before: str, line: str) -> str | None:
    """What joins a line to the text before it; None where a new line begins."""
    bare = line.strip(_BLANKS)
    if _HEADING.match(before) or _HEADING.match(line) or bare.startswith(("|", "---")):
        return None
    if bare and before.strip(_BLANKS).endswith(","):
        return "\n" + line
    if bare.startswith("(※"):
        return " " + bare
    broken = _BROKEN_END.search(before) and _BROKEN_START.match(line)
    marked = any(_MARKED.match(x.lstrip(_BLANKS)) for x in (before, line))
    return " " + line if broken and not marked and not _HEADED.match(before.strip(_BLANKS)) else None


_HEADING, _BROKEN_END, _BROKEN_START = re.compile(r"#{1,6}\s"), re.compile(r"[가-힣·,\-]\Z"), re.compile(r"[가-힣(]")
_MARKED, _HEADED = re.compile(MARKER), re.compile(HEADER.replace("$", r"\Z"))


def merge_lines(text: str | Column) -> Column:
    """Lines that were broken within a sentence, joined: Hangul to Hangul by a blank, after a comma as they are; headings, tables, rules and marked items stay. A fold, as each line looks at what is joined so far."""

    def merged(text: str | None) -> str | None:
        if text is None:
            return None
        first, *rest = text.split("\n")
        out = [first]
        for line in rest:
            if (joint := _joint(out[-1], line)) is None:
                out.append(line)
            else:
                out[-1] += joint
        return "\n".join(out)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(merged)

    return run(text)


#: Lengths of repeated spans, how often one occurs and what share of the text it fills (fixed values).
SPAN_LENGTHS, REPEATS, FILLED = range(5, 16), 3, 0.6


def repeats_much(text: str | None) -> bool:
    """Whether spans of one kind, overlaps counted, with a Latin letter in them fill most of a text."""
    n = len(text or "")
    for size in SPAN_LENGTHS:
        if REPEATS * size > n:
            break
        often = max(REPEATS, FILLED * n / size)
        counts = Counter(text[i : i + size] for i in range(n - size + 1))
        if any(k >= often and k * size / n >= FILLED and re.search("[a-zA-Z]", span) for span, k in counts.items()):
            return True
    return False


def high_repetition(text: str | Column) -> Column:
    """repeats_much() as a column; false for nulls."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repeats_much).astype(bool)

    return run(text)


def section_path(href: Column) -> Column:
    """The path in the package of a section that a manifest names, by itself in the folder Contents; null for anything else and for paths that lead out."""
    path = F.regexp_replace(F.translate(href, "\\", "/"), "^/+", "")
    path = F.when(path.rlike(r"^[Ss]ection\d+\.xml$"), F.concat(F.lit("Contents/"), path)).otherwise(path)
    return F.when(path.rlike(r"(?:^|/)[Ss]ection\d+\.xml$") & ~is_path_traversal(path), path)


def section_number(path: Column) -> Column:
    """The number that sections are in order of, ahead of their names; for other paths one that comes last."""
    digits = F.regexp_extract(path, r"[Ss]ection(\d+)\.xml$", 1)
    return F.when(digits != "", digits.cast("decimal(38,0)")).otherwise(F.lit(2**53 - 1).cast("decimal(38,0)"))


#: What a message says and the error's class, the first that fits (fixed values); signs in one group must all be there, one of each set.
ERROR_CLASSES = (
    ((("DRM",),), "DRM_PROTECTED"),
    ((("암호화", "암호로 보호"),), "ENCRYPTED"),
    ((("optional dependency",),), "MISSING_DEPENDENCY"),
    ((("Invalid string length", "Cannot create a string longer"),), "OUTPUT_TOO_LARGE"),
    ((("ZIP bomb", "ZIP 비압축 크기 초과", "ZIP 엔트리 수 초과"),), "ZIP_BOMB"),
    ((("bomb", "크기 초과", "압축 해제"),), "DECOMPRESSION_BOMB"),
    ((("이미지 기반",),), "IMAGE_BASED_PDF"),
    ((("섹션",), ("찾을 수 없", "없음")), "NO_SECTIONS"),
    ((("시그니처", "복구할 수 없"),), "CORRUPTED"),
)


def error_class(message: Column) -> Column:
    """The class of a parser's message; PARSE_ERROR for other ones and null."""
    out = F.when(F.lit(False), "")
    for groups, name in ERROR_CLASSES:
        fits = F.lit(True)
        for signs in groups:
            fits = fits & message.rlike("|".join(re.escape(x) for x in signs))
        out = out.when(fits, name)
    return out.otherwise("PARSE_ERROR")
