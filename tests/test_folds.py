from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import geometry, numbering, tables


def test_html_cells():
    spanned = "<table><tr><th colspan=2>a</th><th rowspan='2'>b</th></tr><tr><td>c</td><td>d<br>e &amp; f</td></tr></table>"
    assert list(tables.html_cells(spanned)) == [(0, 0, "a", 2, 1), (0, 2, "b", 1, 2), (1, 0, "c", 1, 1), (1, 1, "d\ne & f", 1, 1)]
    inner = "<table><tr><td>x<table><tr><td>1 &lt; 2</td></tr></table></td></tr></table>"
    assert list(tables.html_cells(inner)) == [(0, 0, "x<table><tr><td>1 &lt; 2</td></tr></table>", 1, 1)]
    assert list(tables.html_cells("<table><tr><td colspan=0 rowspan=x>y</td></tr></table>")) == [(0, 0, "y", 1, 1)]
    for bad in (None, "", "plain", "<table><tr><td>x</td></tr>", "</table><table>"):
        assert list(tables.html_cells(bad)) == []


def test_advance():
    state: dict = {}
    steps = [(1, 0), (1, 1), (1, 1), (2, 1), (2, 2), (1, 1), (2, 2), (1, 0)]
    assert [numbering.advance(state, *s)[:3] for s in steps] == [[1, 0, 0], [1, 1, 0], [1, 2, 0], [1, 1, 0], [1, 1, 1], [1, 3, 0], [1, 1, 2], [2, 0, 0]]
    state = {}
    assert numbering.advance(state, None, None) == numbering.advance({}, 0, -3) == [1, 0, 0, 0, 0, 0, 0]
    assert numbering.advance(state, 3, 1)[:2] == [1, 1] and numbering.advance(state, 0, 9) == [1, 1, 0, 0, 0, 0, 1]


def test_repeats():
    assert text.repeats_much("abcde" * 3) and text.repeats_much("x" * 15)
    assert not text.repeats_much("12345" * 3) and not text.repeats_much("abcde" * 2) and not text.repeats_much(None)


def test_lines_and_hidden(spark):
    rows = [(1, 1, i, y) for i, y in enumerate([None, 10.0, 12.0, None, 13.5, 20.0, 20.0])] + [(None, 1, 0, 5.0), (None, 1, 1, 50.0)]
    items = spark.createDataFrame(rows, "doc_id long, page int, item_id int, y double").withColumn("line_no", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r["line_no"] for r in geometry.line_numbers(items).collect()}
    assert [got[1, i] for i in range(7)] == [0, 0, 0, 0, 1, 2, 2] and got[None, 0] == 0 and got[None, 1] == 1
    assert geometry.line_numbers(items.limit(0)).count() == 0
    placed = "text string, x double, y double, w double, h double, page_w double, page_h double"
    seen = geometry.visible_items(spark.createDataFrame([("a", 0.0, 0.0, 0.0, 9.0, 100.0, 200.0), (" ", 0.0, 0.0, 0.0, 9.0, 100.0, 200.0), ("c", 121.0, 0.0, 5.0, 9.0, 100.0, 200.0), ("d", None, 220.0, 5.0, 9.0, 100.0, 200.0)], placed))
    assert [r["text"] for r in seen.collect()] == [" ", "d"]
