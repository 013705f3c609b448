import random

import numpy as np
from pyspark.sql import functions as F

from quire.operators import geometry, layout, markdown, style


def test_style():
    codes = lambda t: {f["rule"] for f in style.lint_style(t)}
    assert codes("○ 빈집 정비가 시급하다") == {"DA_ENDING"}
    assert codes("| 표 이다 |") == codes("# 제목이다") == codes("```\n했다\n```") == codes(None) == set()
    assert "DEONTIC" in codes("⇒ 보급해야 한다") and "RHETORIC_CONTRAST" in codes("- 사람이 아니라 마음")
    assert codes("> 시설을 정비하고 인력을 늘려\n> 안전을 높이고자 함.") == set()


def test_wrap():
    assert layout.text_width("가나", 1000) == 1940 and layout.text_width(" ", 1000) == 500
    starts, last = layout.wrap("가나 다라 마바", 2500, 2500, 1000)
    assert starts == [0, 3, 6] and last == 1940
    assert layout.wrap("가나다라마바", 2000, 2000, 1000)[0] == [0, 2, 4]
    assert layout.wrap("가나다라.", 3900, 3900, 1000, by_word=False)[0] == [0, 3]
    assert layout.wrap("", 100, 100, 1000) == ([0], 0.0)
    assert layout.fit_ratio("가나 다", 2500, 2500, 1000, 100, 50) == 73
    assert layout.fit_ratio("가", 2500, 2500, 1000, 100, 50) is None


def test_column_widths():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 12)
        got = layout.column_widths([rng.random() * 10 for _ in range(n)], total := rng.randint(5000, 50_000))
        assert sum(got) == total and min(got) > 0


def test_markdown_blocks():
    text = "# 제목\n\n글 하나\n이어서\n\n- a\n  - b\n- c\n\n> 인용\n> 둘\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n~~~py\n# no\n~~~\n---\n$$x+1$$\n<table><tr><td>q</td></tr></table>\n<table>open"
    got = [(b["type"], b["text"], b["level"], b["list_depth"]) for b in markdown.parse_blocks(text)]
    assert got == [
        ("heading", "제목", 1, None), ("paragraph", "글 하나 이어서", None, None), ("list_item", "a", None, 0), ("list_item", "b", None, 1), ("list_item", "c", None, 0), ("blockquote", "인용\n둘", None, None),
        ("table", "| x | y |\n| --- | --- |\n| 1 | 2 |", None, None), ("code_block", "# no", None, None), ("separator", None, None, None), ("equation", "x+1", None, None),
        ("html_table", "<table><tr><td>q</td></tr></table>", None, None), ("paragraph", "<table>open", None, None),
    ]
    assert markdown.parse_blocks(None) == []


def test_inline_and_escape():
    assert markdown.escape_gfm("a*b ![i](x_1.png) $a_b$ c_d") == "a\\*b ![i](x_1.png) $a_b$ c\\_d"
    assert markdown.span_markdown([{"text": " a ", "bold": True}, {"text": "b", "italic": True, "strike": True, "underline": True}, {"text": "c*", "code": True}]) == " **a** <u>~~*b*~~</u>`c*`"
    assert [(s["text"], s["bold"], s["italic"]) for s in markdown.inline_spans("a **b** snake_case *c")] == [("a ", False, False), ("b", True, False), (" snake_case *c", False, False)]
    page = markdown.render_html("# A\n\n- x\n  1. [y](javascript:1)\n\ntext <b>")
    assert "<h1>A</h1><ul><li>x</li><ol><li>y</li></ol></ul><p>text &lt;b&gt;</p>" in page


def test_clean_page_text(spark):
    df = spark.createDataFrame([("3\n- 2 -\n본문\n12\n더\n\n\n\n끝\n7",)], "t string")
    assert df.select(markdown.clean_page_text(F.col("t")).alias("x")).first().x == "본문\n더\n\n끝"


def test_geometry(spark):
    assert geometry.clusters(np.array([1.0, 1.5, 9.0, 2.0]), 1.0).tolist() == [0, 0, 1, 0]
    x, y = np.array([0.0, 0.0, 50.0, 50.0, 0.0]), np.array([80.0, 60.0, 80.0, 60.0, 100.0])
    w, h = np.array([40.0, 40.0, 40.0, 40.0, 90.0]), np.full(5, 15.0)
    assert geometry.cut_order(x, y, w, h)[0] == 4
    lines = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 1, 10.0, 0.0, 10.0, 9.0), (1, 1, 2, 40.0, 0.0, 50.0, 0.0)], "doc_id long, page int, line_id long, x1 double, y1 double, x2 double, y2 double")
    assert [r.group for r in geometry.components_of_lines(lines).orderBy("line_id").collect()] == [0, 0, 2]
    items = spark.createDataFrame([(1, 1, 0, "a", 0.0, 100.0, 50.0, 10.0), (1, 1, 1, "b", 0.0, 50.0, 50.0, 10.0)], "doc_id long, page int, item_id int, text string, x double, y double, w double, h double")
    rulings = spark.createDataFrame([(1, 1, 0.0, 48.0, 99.0), (1, 1, 0.0, 60.0, 55.0)], "doc_id long, page int, x1 double, x2 double, y double")
    assert [(r.underlined, r.struck) for r in geometry.marked_items(items, rulings).orderBy("item_id").collect()] == [(True, False), (False, True)]
