import pytest
from pyspark.sql import functions as F

from quire.functions import fields, numbers, sniff, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "fmt", "want"), [
    ("19900315", "date:yy.mm.dd", "90.03.15"), ("900315", "date:yyyy-mm-dd", "1990-03-15"), ("01012345678", "phone:intl", "+82-10-1234-5678"),
    ("900315-1234567", "rrn:masked", "900315-1******"), ("1234567890", "mask:###-##-#####", "123-45-67890"), ("x", "unknown", "x"), ("12", "###", "12"),
])
def test_fill_formats(spark, value, fmt, want):
    assert one(spark, fields.format_fill_value(F.lit(value), F.lit(fmt))) == want


def test_labels(spark):
    yes, no = ["연번1", "제1항목", "업 체 명", "Date of Birth", "성명"], ["6개월", "1억원", "2026년", "제3회", "해당없음", "Seoul", ""]
    rows = spark.createDataFrame([(x,) for x in yes + no], "x string").select("x", fields.is_label_cell(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == dict.fromkeys(yes, True) | dict.fromkeys(no, False)


def test_field_types(spark):
    cases = [("동의", "□", "checkbox"), ("x", "900101-1234567", "idnum"), ("x", "2026. 7. 5.", "date"), ("x", "02-123-4567", "phone"), ("x", "a@b.co", "email"), ("x", "1,200", "amount"), ("금액", "", "amount"), ("x", "y", "text")]
    rows = spark.createDataFrame(cases, "l string, v string, want string").select("want", fields.field_type(F.col("l"), F.col("v")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_sniff(spark):
    cases = [
        (b"\x89PNG\r\n\x1a\n0000", "image"), (b"\xff\xd8\xff000000000", "image"), (b"RIFF0000WEBPVP8 ", "image"), (b"\xd0\xcf\x11\xe0", "hwp"), (b"%PDF-1.7", "pdf"),
        (b"HWP Document File V3.00 \x1a", "hwp3"), (b"PK\x03\x04", "hwpx"), (b"\xef\xbb\xbf <?xml version='1.0'?><HWPML>", "hwpml"), (b"abc", "unknown"), (b"none of it", "unknown"), (None, "unknown"),
    ]
    rows = spark.createDataFrame(cases, "c binary, want string").select("want", sniff.detect_format(F.col("c")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_numbers(spark):
    rows = spark.createDataFrame([(1.0, False), (59.0, False), (61.0, False), (45306.0, False), (0.0, True), (-5.0, False), (2958466.0, False)], "s double, o boolean")
    got = [r[0] for r in rows.select(numbers.serial_to_iso(F.col("s"), F.col("o"), F.lit("date"))).collect()]
    assert got == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-01-15", "1904-01-01", None, None]
    for n, want in ((1, "I"), (4, "IV"), (1994, "MCMXCIV"), (3999, "MMMCMXCIX"), (4000, "4000"), (0, "0")):
        assert one(spark, numbers.roman_numeral(F.lit(n))) == want
    for n, want in ((0, "가"), (13, "하"), (14, "거")):
        assert one(spark, numbers.hangul_ordinal(F.lit(n))) == want
    for n, want in ((0, "①"), (19, "⑳"), (20, "㉑"), (35, "㊱"), (49, "㊿"), (50, "(51)")):
        assert one(spark, numbers.circled_number(F.lit(n))) == want
    for n, want in ((1, "a"), (26, "z"), (27, "aa"), (702, "zz"), (703, "aaa")):
        assert one(spark, numbers.latin_ordinal(F.lit(n))) == want
    assert one(spark, numbers.column_index(F.lit("AB123"))) == 27
    assert one(spark, numbers.row_index(F.lit("AB123"))) == 122
    assert [one(spark, numbers.classify_date_format(F.lit(c))) for c in ("yyyy-mm-dd", "hh:mm", "0.00", '"y"0')] == ["date", "datetime", None, None]
    assert one(spark, numbers.pdf_date(F.lit("D:20240115"))) == "2024-01-15T00:00:00"


def test_text(spark):
    assert one(spark, text.sanitize(F.lit("현 장 대 응 단 장"))) == "현장대응단장"
    assert one(spark, text.sanitize(F.lit("앞\n사각형입니다.\n뒤"))) == "앞\n\n뒤"
    assert one(spark, text.length16(F.lit("😀x"))) == 3
    assert one(spark, text.squeeze(F.lit("　a \t b "))) == "a b"
    assert one(spark, text.sanitize_href(F.lit("https://a/(b)"))) == "https://a/%28b%29"
    assert one(spark, text.sanitize_href(F.lit("javascript:x"))) is None
    assert [one(spark, text.is_private_ip(F.lit(x))) for x in ("10.1.2.3", "172.32.0.1", "::1", "fd00::1", "8.8.8.8", "100.64.0.1")] == [True, False, True, True, False, True]
    assert [one(spark, text.contains_inline_math(F.lit(x))) for x in ("값 $x+1$", "예산 $5", "\\$a$")] == [True, False, False]


def test_numbers_are_written_as_in_the_format():
    from quire.sources.office import clean_number

    cases = {"0.00001": "0.00001", "1234567890123456.5": "1234567890123460", "-0.0": "0", "0.30000000000000004": "0.3", "0.0000001": "1e-7", "100.0": "100", "-2.50": "-2.5", "7": "7"}
    assert {x: clean_number(x) for x in cases} == cases


def test_private_characters_and_lines(spark):
    from quire.functions import text

    rows = [("\U000f012b\U000f02b1\U000f0001",), (None,), ("",), ("가나\n다라",), ("가나,\nx",), ("# 가\n나",), ("제1조 목적\n가나",), ("1. 가\n나",), ("가\n(※ 나)",), ("가나\n| 다",)]
    df = spark.createDataFrame(rows, "text string")
    got = [tuple(r) for r in df.select(text.map_private(df["text"]), text.merge_lines(df["text"])).collect()]
    assert got[0][0] == "●(인)①\U000f0001" and got[1] == (None, None)
    assert [r[1] for r in got[2:]] == ["", "가나 다라", "가나,\nx", "# 가\n나", "제1조 목적\n가나", "1. 가\n나", "가 (※ 나)", "가나\n| 다"]


def test_displayed_formulas_end():
    from quire.operators.markdown import parse_blocks

    kinds = lambda x: [(b["type"], b["text"]) for b in parse_blocks(x)]
    assert kinds("$$\nx\n\n# h\ntext") == [("paragraph", "$$ x"), ("heading", "h"), ("paragraph", "text")]
    assert kinds("$$x$$ tail") == [("equation", "x"), ("paragraph", "tail")]
    assert kinds("a\r\r$$a\nb$$\nz") == [("paragraph", "a"), ("equation", "a\nb"), ("paragraph", "z")]
