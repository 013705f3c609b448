import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, chunks, compare, forms, lint, quality, redact, tables


@pytest.mark.parametrize(("text", "want", "rules"), [
    ("900101-2345678", "900101-●●●●●●●", redact.DEFAULT_RULES), ("900101-9234567", None, redact.DEFAULT_RULES), ("999999-1234567", None, redact.DEFAULT_RULES),
    ("010-1234-5678", "010-●●●●-5678", redact.DEFAULT_RULES), ("02-123-4567", "02-●●●-4567", redact.DEFAULT_RULES), ("1588-1234", "1588-●●●●", redact.DEFAULT_RULES),
    ("01012345678", "010●●●●5678", redact.DEFAULT_RULES), ("010.1234-5678", None, ("phone",)), ("kim01012345678@example.com", "k" + "●" * 13 + "@example.com", redact.DEFAULT_RULES),
    ("4111-1111-1111-1111", "4111-●●●●-●●●●-1111", redact.DEFAULT_RULES), ("1234-5678-9012-3456", None, ("card",)), ("110-234-567890", "●●●-●●●-567890", redact.DEFAULT_RULES),
    ("123-45-67890", "●●●-●●-67890", redact.DEFAULT_RULES), ("2026-07-16", None, redact.DEFAULT_RULES), ("12-34-567890-12", "12-34-●●●●●●-●●", ("driver", "account")),
    ("M12345678", None, redact.DEFAULT_RULES), ("M12345678", "M●●●●●●●●", ("passport",)),
])
def test_redact(text, want, rules):
    got, hits = redact.redact_text(text, rules)
    assert got == (want or text)
    assert len(got) == len(text)
    assert bool(hits) == (want is not None)


def test_redact_column(spark):
    df = spark.createDataFrame([("😀 a@b.co\ndata:image/ 010-1234-5678",), (None,), ("",)], "t string").select(redact.redacted("t").alias("r"))
    rows = [r.r for r in df.collect()]
    assert rows[0].text == "😀 a@b.co\ndata:image/ 010-1234-5678" and rows[0].hits[0]["index"] == 3
    assert rows[1].text is None and rows[1].hits == [] and rows[2].text == ""
    for bad in ("**", "a", "5", ""):
        with pytest.raises(ValueError):
            redact.redacted("t", mark=bad)


def test_lint():
    codes = lambda t: {f["rule"] for f in lint.lint_text(t)}
    assert "DATE_NO_SPACE" in codes("2025.1.6 회의")
    assert codes("2025. 1. 6. 개최") == set()
    assert "COLON_SPACE" not in codes("https://example.com")
    assert codes("```\n2025.1.6\n~~~\n2025.1.6\n```") == set()
    assert codes(None) == set()


def test_pages(spark):
    make = lambda pages: spark.createDataFrame([(1, i, f"t{i}", p) for i, p in enumerate(pages)], "doc_id long, block_id int, text string, page_number int")
    got = lambda pages: [(r.page_number, r.markdown) for r in blocks.page_markdown(make(pages)).orderBy("page_number").collect()]
    assert got([1, 2, 1]) == [(1, "t0\n\nt2"), (2, "t1")]
    assert got([3, None, 4]) == [(3, "t0\n\nt1"), (4, "t2")]
    assert got([None, 5]) == [(5, "t0\n\nt1")]
    assert got([1, 3]) == [(1, "t0"), (2, ""), (3, "t1")]
    assert got([None, None]) == []


def test_running_headers(spark):
    texts = ["2. 과제", "a", "2. 과제", "b", "2. 과제", "c", "1. x", "1. x"]
    df = spark.createDataFrame([(1, i, "paragraph", t) for i, t in enumerate(texts)], "doc_id long, block_id int, type string, text string")
    assert [r.text for r in blocks.dedupe_running_headers(df).orderBy("block_id").collect()] == ["2. 과제", "a", "b", "c", "1. x", "1. x"]


def test_quality(spark):
    rare = "".join(chr(0xAC00 + 28 * i + 9) for i in range(40))
    df = spark.createDataFrame([(0, ""), (1, "" * 50), (2, "\0" * 50), (3, rare), (4, "가나다라마바사아자차카타파하" * 3), (5, None)], "id long, text string")
    assert [r.ocr_reason for r in quality.page_quality(df, ["id"]).orderBy("id").collect()] == ["low_text", "high_pua", "high_control", "garbled_hangul", None, "low_text"]


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, "A", 2, 1), (1, 1, 0, "B", 1, 1), (1, 1, 1, "C|d", 1, 1), (1, 1, 2, " ", 1, 1)], "t long, r int, c int, text string, col_span int, row_span int")
    grid = tables.build_grid(cells, ["t"])
    assert [(r.r, r.c, r.text, r.is_anchor) for r in grid.orderBy("r", "c").collect()] == [(0, 0, "A", True), (0, 1, "", False), (1, 0, "B", True), (1, 1, "C|d", True)]
    assert 'colspan="2"' in tables.to_markdown(grid, ["t"]).first().markdown
    plain = tables.build_grid(cells.where("r = 1"), ["t"])
    assert tables.to_text(plain, ["t"]).first().text == "B / C\\|d"
    assert tables.build_grid(cells, ["t"], keep_anchored=True).agg(F.max("c")).first()[0] == 2
    assert tables.build_grid(cells.where("r > 5"), ["t"]).count() == 0


def test_cross_page(spark):
    heads = spark.createDataFrame([(1, 0, 1, 2, 10.0, 110.0), (1, 1, 2, 2, 12.0, 111.0), (1, 2, 4, 2, 12.0, 111.0)], "doc_id long, table_id int, page int, cols int, left double, right double")
    grid = spark.createDataFrame([(1, t, r, c, x) for t, rows in enumerate([["h1", "h2", "a", "b"], ["h 1", "h2", "c", "d"], ["e", "f"]]) for i, x in enumerate(rows) for r, c in [divmod(i, 2)]], "doc_id long, table_id int, r int, c int, text string")
    got = tables.merge_cross_page(heads, grid).where("table_id = 0").orderBy("r", "c").collect()
    assert [r.text for r in got] == ["h1", "h2", "a", "b", "c", "d"]


def test_chunks(spark):
    rows = [
        ("heading", "1부", 1, None), ("heading", "개요", 2, None), ("paragraph", "글", None, None), ("list", "가. 하나", None, 0), ("list", "세부", None, 1), ("list", "더 세부", None, 2),
        ("list", "다른 세부", None, 1), ("paragraph", " ", None, None), ("table", "| a |", None, None), ("heading", "끝", 2, None), ("paragraph", "마지막", None, None),
    ]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, block_id int, type string, text string, level int, list_depth int")
    got = {(r.first_block, r.last_block): (r.type, r.breadcrumb) for r in chunks.chunks(df).collect()}
    assert got[(2, 3)] == ("text", ["1부", "개요"])
    assert got[(5, 5)] == ("text", ["1부", "개요", "가. 하나", "세부"])
    assert got[(4, 4)][1] == got[(6, 6)][1] == ["1부", "개요", "가. 하나"]
    assert got[(8, 8)][0] == "table" and not any(a <= 7 <= b for a, b in got)
    assert got[(10, 10)] == ("text", ["1부", "끝"])


def test_word_diff_rebuilds_both():
    a, b = "the quick  brown fox", "the slow brown fox jumps"
    steps = compare.word_diff(a, b)
    assert "".join(s["text"] for s in steps if s["type"] != "insert") == a
    assert "".join(s["text"] for s in steps if s["type"] != "delete") == b
    assert compare.edit_distance("kitten", "sitting") == 3 and compare.edit_distance("", "ab") == 2


def test_block_diff(spark):
    schema = "pair_id long, block_id int, type string, text string"
    a = spark.createDataFrame([(1, 0, "paragraph", "same text"), (1, 1, "paragraph", "gone entirely"), (1, 2, "paragraph", "slightly changed here"), (2, 0, "paragraph", "only before")], schema)
    b = spark.createDataFrame([(1, 0, "paragraph", "same  text"), (1, 1, "paragraph", "slightly changed there"), (1, 2, "heading", "NEW 99")], schema)
    got = {r.pair_id: (r.added, r.removed, r.modified, r.unchanged) for r in compare.diff_stats(compare.diff_blocks(a, b)).collect()}
    assert got == {1: (1, 1, 1, 1), 2: (0, 1, 0, 0)}


def test_forms(spark):
    grid = spark.createDataFrame([(1, 0, 0, 0, "성명"), (1, 0, 0, 1, "김"), (1, 1, 0, 0, "Item A"), (1, 1, 0, 1, "Item B"), (1, 1, 1, 0, "x"), (1, 1, 1, 1, "y")], "doc_id long, table_id int, r int, c int, text string")
    got = {(r.label, r.value) for r in forms.table_fields(grid, ["doc_id"]).collect()}
    assert got == {("성명", "김"), ("Item A", "x"), ("Item B", "y")}
    lines = spark.createDataFrame([(1, 0, "paragraph", "성명: 홍길동  작성일자: 2026")], "doc_id long, block_id int, type string, text string")
    assert {(r.label, r.value) for r in forms.inline_fields(lines, ["doc_id"]).collect()} == {("성명", "홍길동"), ("작성일자", "2026")}
    labels = spark.createDataFrame([("성명",), ("성 명 :",), ("대리인",), ("연락처번호",)], "label string")
    values = spark.createDataFrame([("성명", 0), ("대리인성명", 1), ("연락처", 2)], "key string, key_no int")
    assert [r.matched_key for r in forms.match_keys(labels, values).orderBy("label").collect()] == [None, "성명", "성명", "연락처"]


def test_list_chains(spark):
    texts = ["1. a", "x", "2. b", "가. c", "3. d", "7. e"]
    df = spark.createDataFrame([(1, i, "paragraph", t) for i, t in enumerate(texts)], "doc_id long, block_id int, type string, text string")
    assert [(r.block_id, r.chain) for r in blocks.list_chains(df).orderBy("block_id").collect()] == [(0, 0), (2, 0), (4, 0)]
    assert json.dumps([1]) == "[1]" and pd is not None
