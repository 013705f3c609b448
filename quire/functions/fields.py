"""Form labels, field types and value formats as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import WHITE, trim

#: Words that make a cell a label (fixed values).
LABEL_KEYWORDS = (
    "성명", "이름", "주소", "전화", "전화번호", "휴대폰", "핸드폰", "연락처", "생년월일", "주민등록번호", "소속", "직위", "직급", "부서", "이메일", "팩스", "학교", "학년", "반",
    "번호", "신청인", "대표자", "담당자", "작성자", "확인자", "승인자", "일시", "날짜", "기간", "장소", "목적", "사유", "비고", "금액", "수량", "단가", "합계", "계", "소계",
    "등록기준지", "본적", "위임인", "청구사유", "소명자료",
)
#: English words that are labels without a colon, and words between them that don't count (fixed values).
ENGLISH_LABELS = (
    "name", "date", "address", "tel", "phone", "mobile", "fax", "email", "e-mail", "dept", "department", "division", "title", "position", "grade", "rank", "birth", "nationality",
    "sex", "gender", "signature", "sign", "seal", "remarks", "note", "period", "place", "purpose", "reason", "amount", "total", "sum", "qty", "quantity", "unit", "no", "id", "passport",
)
ENGLISH_FILLERS = ("of", "the", "and", "or", "in")
#: Units of numeric values and endings of sentences, which labels don't have (fixed values).
UNITS = "원|명|건|개|회|부|매|장|점|호|번|년|월|일|시|분|초|개월|주년|차례|퍼센트"
ENDINGS = "입니다|합니다|습니다|하세요|십시오|시오|바랍니다|바람|할 것|할것|하며|하고|한다|된다|됨|음|임"
#: Words in a label that tell its field's type, in this order (fixed values).
TYPE_WORDS = (
    ("주민등록번호|외국인등록번호", "idnum"),
    ("생년월일|일시|날짜|일자|기간|연월일|년월일|신청일|작성일|발급일|접수일", "date"),
    ("전화|연락처|휴대폰|핸드폰|팩스", "phone"),
    ("이메일|전자우편|(?i:email)", "email"),
    ("금액|단가|수량|합계|소계|예산|비용|인원|급여|연봉", "amount"),
)
_NOTES = "[¹²³⁴⁵⁶⁷⁸⁹⁰*※]+$"


def bare_label(text: Column) -> Column:
    """Without note marks at the end."""
    return trim(F.regexp_replace(trim(text), _NOTES, ""))


def is_keyword_label(text: Column) -> Column:
    """Up to 15 characters with a label word."""
    bare = bare_label(text)
    return (bare != "") & (F.length(bare) <= 15) & bare.rlike("|".join(LABEL_KEYWORDS))


def is_label_cell(text: Column) -> Column:
    """Whether a cell reads like a label: a label word, a few Hangul syllables that are no value or sentence, `label:`, or English label words."""
    bare = bare_label(text)
    compact = F.regexp_replace(bare, f"{WHITE}+", "")
    hangul = F.length(F.regexp_replace(compact, "[^가-힣]", ""))
    short = (
        compact.rlike("^[가-힣0-9()（）·:：-]{2,12}$") & (hangul >= 2) & ((F.length(compact) <= 8) | (F.size(F.split(bare, f"{WHITE}+")) <= 2))
        & ~compact.rlike(rf"^제?\d+(?:[.,]\d+)*[십백천만억조]*(?:{UNITS})?$") & ~bare.rlike(f"(?:{ENDINGS})$") & ~compact.rlike("^[(（]주[)）]|^주식회사")
    )
    words = F.filter(F.split(F.lower(bare), r"[\s/&]+"), lambda w: (w != "") & ~w.isin(*ENGLISH_FILLERS))
    english = bare.rlike(r"^[A-Za-z][A-Za-z\s./&-]{0,19}$") & F.size(words).between(1, 3) & F.forall(words, lambda w: F.regexp_replace(w, r"\.$", "").isin(*ENGLISH_LABELS))
    any_of = bare.rlike("|".join(LABEL_KEYWORDS)) | short | bare.rlike(r"^[가-힣A-Za-z\s]+[:：]$") | english
    return F.coalesce((bare != "") & (F.length(bare) <= 30) & any_of, F.lit(False))


def normalize_label(text: Column) -> Column:
    """For comparing labels: without colons, parentheses, middle dots and white space."""
    return F.regexp_replace(F.regexp_replace(text, "[:：()（）·]", ""), WHITE, "")


def field_type(label: Column, value: Column) -> Column:
    """checkbox, idnum, date, phone, email, amount or text: by the value's pattern, else by the label's words."""
    v, words = trim(value), F.regexp_replace(label, f"{WHITE}+", "")
    out = (
        F.when(value.rlike("[□☑✓✔]") | label.rlike("[□☑✓✔]"), "checkbox")
        .when(v.rlike(r"^\d{6}[-\s]?[1-4]\d{6}$"), "idnum")
        .when(v.rlike(r"^\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}\s*일?\s*\.?$"), "date")
        .when(v.rlike(r"^0\d{1,2}[-.)\s]?\d{3,4}[-.\s]?\d{4}$"), "phone")
        .when(v.rlike(r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$"), "email")
        .when((v.rlike(r"^[\d,.\s]+(?:원|명|건|개|회|부|매|%)$") & v.rlike(r"\d")) | v.rlike(r"^\d{1,3}(?:,\d{3})+$"), "amount")
    )
    for pattern, name in TYPE_WORDS:
        out = out.when(words.rlike(pattern), name)
    return out.otherwise("text")


def is_required_label(label: Column) -> Column:
    return label.rlike(r"[*※★]|\(\s*필수\s*\)|（\s*필수\s*）")


def is_empty_value(value: Column) -> Column:
    """Nothing but placeholders."""
    return trim(value).rlike(r"^[\s_()（）\-—–~.·,]*$")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _ymd(value: Column) -> tuple[Column, Column, Column]:
    """Year, month and day as text, null each if value is no date."""
    parts = F.filter(F.split(value, "[^0-9]+"), lambda x: x != "")
    d = _digits(value)
    century = lambda yy: F.when(yy.cast("int") <= 29, 2000 + yy.cast("int")).otherwise(1900 + yy.cast("int")).cast("string")
    three = F.size(parts) == 3
    y0, m0, d0 = (F.get(parts, F.lit(i)) for i in range(3))
    year = F.when(three, F.when(F.length(y0) >= 3, y0).otherwise(century(y0))).when(F.length(d) >= 8, F.substring(d, 1, 4)).when(F.length(d) == 6, century(F.substring(d, 1, 2)))
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    month = F.when(three, pad(m0)).when(F.length(d) >= 8, F.substring(d, 5, 2)).when(F.length(d) == 6, F.substring(d, 3, 2))
    day = F.when(three, pad(d0)).when(F.length(d) >= 8, F.substring(d, 7, 2)).when(F.length(d) == 6, F.substring(d, 5, 2))
    fine = month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31)
    return tuple(F.when(fine, x) for x in (year, month, day))


def format_date(value: Column, style: Column) -> Column:
    """The value's date in a style of yyyy, yy, mm, dd, m and d (any case); the value where it is no date."""
    year, month, day = _ymd(value)
    out = F.when(style == "", F.lit("yyyy-mm-dd")).otherwise(style)
    for token, part in (
        ("(?i)yyyy", year), ("(?i)yy", F.substring(year, 3, 2)), ("(?i)mm", month), ("(?i)dd", day),
        ("(?i)(?<![a-z])m(?![a-z])", month.cast("int").cast("string")), ("(?i)(?<![a-z])d(?![a-z])", day.cast("int").cast("string")),
    ):
        out = F.regexp_replace(out, F.lit(token), part)
    return F.when(year.isNull(), value).otherwise(out)


def mask_digits(value: Column, pattern: Column) -> Column:
    """Each # takes the value's next digit; the value itself where their numbers differ."""
    d, marks = _digits(value), F.length(F.regexp_replace(pattern, "[^#]", ""))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    fold = lambda a, c: F.struct(F.concat(a["out"], F.when(c == "#", F.substr(d, a["used"] + 1, F.lit(1))).otherwise(c)).alias("out"), (a["used"] + F.when(c == "#", 1).otherwise(0)).alias("used"))
    return F.when((marks == 0) | (marks != F.length(d)), value).otherwise(F.aggregate(F.split(pattern, ""), zero, fold, lambda a: a["out"]))


def format_phone(value: Column, style: Column) -> Column:
    """A number of nine digits or more in the style named; with a two-digit area for 02, else three."""
    d = _digits(value)
    area = F.when(d.startswith("02"), 2).otherwise(3)
    a, b, c = F.substr(d, F.lit(1), area), F.substr(d, area + 1, F.greatest(F.length(d) - 4 - area, F.lit(0))), F.right(d, F.lit(4))
    home = F.substr(a, F.lit(2))
    joined = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    styled = (
        F.when(style == "digits", d).when(style == "dot", joined(a, ".", b, ".", c)).when(style == "space", joined(a, " ", b, " ", c))
        .when(style == "intl", joined("+82-", home, "-", b, "-", c)).when(style == "intl-paren", joined("82)", home, "-", b, "-", c)).otherwise(joined(a, "-", b, "-", c))
    )
    return F.when(F.length(d) < 9, value).otherwise(styled)


def format_rrn(value: Column, style: Column) -> Column:
    """A resident number of 13 digits in the style named."""
    d = _digits(value)
    front = F.substring(d, 1, 6)
    styled = (
        F.when(style == "digits", d).when(style == "front", front).when(style == "masked", F.concat(front, F.lit("-"), F.substring(d, 7, 1), F.lit("******")))
        .otherwise(F.concat(front, F.lit("-"), F.substring(d, 7, 7)))
    )
    return F.when(F.length(d) != 13, value).otherwise(styled)


def format_fill_value(value: Column, fmt: Column) -> Column:
    """A value in a format `kind:style` or a free pattern of # or of date tokens; unknown formats leave it unchanged."""
    kind = F.when(fmt.contains(":"), F.substring_index(fmt, ":", 1)).otherwise(fmt)
    style = F.when(fmt.contains(":"), F.regexp_replace(fmt, "^[^:]*:", "")).otherwise("")
    return (
        F.when(fmt.isNull() | (fmt == ""), value).when(kind == "date", format_date(value, style)).when(kind == "phone", format_phone(value, style)).when(kind == "rrn", format_rrn(value, style))
        .when(kind == "mask", mask_digits(value, style)).when(kind == "digits", F.when(_digits(value) == "", value).otherwise(_digits(value))).when(kind == "upper", F.upper(value))
        .when(kind == "lower", F.lower(value)).when(kind == "nospace", F.regexp_replace(value, f"{WHITE}+", "")).when(fmt.contains("#"), mask_digits(value, fmt))
        .when(fmt.rlike("yy|mm|dd"), format_date(value, fmt)).otherwise(value)
    )
