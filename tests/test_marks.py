import pytest
from pyspark.sql import functions as F

from quire.functions import formula, marks, sniff, text
from quire.operators import geometry, layout, markdown, numbering


def test_formulas(spark):
    cases = {
        r"\mathrm { m o d d } ( 6 4 )  \quad \,": r"\mathrm{modd}(64)", r"x^{}_{}{} + \hat{ } 12": "x+12", r"\cdotd + \alphab=\timesd_{k} ": r"\cdot d+\alpha b=\times d_{k}", r"{ {} }x^{{ }}=1+2": "x=1+2",
        r"a\ b = 3 \\ab c+1": r"a\ b=3\\abc+1", r"\cdotd{x}=1": r"\cdotd{x}=1", r"\sqrt{d_{k}}": r"\sqrt{d_{k}}", "PE_{pos+k}": "PE_{pos+k}", r"\pm \pm \pm \pm": "", r"\cap \exists \exists \rceil": "",
        r"\frac{a}{a}+b=1": "", r"C(\tau_{2},\mu,\mu)": "", "C(T_{2})(T_{2})": "", "1.0": "", "": "", " \t ": "", r"\mathrm{to}-\infty": "", r"cl_{\mathrm{model}}": "", r"\begin{aligned}a+b\end{aligned}": "",
        r"\begin{matrix}a&\cdots\\b&\cdots\end{matrix}+1=2": "", None: None,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "t string").select("t", formula.cleaned(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_numbers_in_formats(spark):
    n = F.col("n")
    rows = spark.createDataFrame([(0,), (1,), (4,), (27,), (51,)], "n int").select("n", *[marks.number_text(n, f).alias(f) for f in (*marks.HEAD_FORMATS.values(), "digit")]).collect()
    got = {r.n: r for r in rows}
    assert [got[4][f] for f in marks.HEAD_FORMATS.values()] == ["④", "IV", "iv", "D", "d", "라", "㉱", "ㄹ", "㉣", "사", "四"] and got[4].digit == "4"
    assert got[0].circled == "0" and got[0].written_hanja == "零" and got[27].latin_lower == "aa" and got[27].jamo == "27" and got[51].circled == "(51)" and got[27].circled_hangul == "퍼"
    row = spark.createDataFrame([("^1^2^3^8", [0, 2], [5], [0, 8, 1])], "p string, c array<int>, s array<int>, f array<int>")
    assert row.select(marks.expanded(F.col("p"), F.col("c"), F.col("s"), F.col("f")).alias("x")).first().x == "5나①^8"


def _brute(depths):
    """Places, and whether there are siblings, from the path of every item."""
    path, seen, keys = [], {}, []
    for d in depths:
        path = (path + [0] * (d + 1))[: d + 1]
        path[d] += 1
        keys.append((tuple(path[:d]), d))
        seen.setdefault(keys[-1], []).append(len(keys) - 1)
    return [(seen[k].index(i), len(seen[k]) > 1) for i, k in enumerate(keys)]


def test_item_marks(spark):
    import random

    rng = random.Random(5)
    docs = {k: [rng.choice([0, 0, 1, 1, 2, 3, 7]) for _ in range(40)] for k in range(4)}
    df = spark.createDataFrame([(k, i, d) for k, ds in docs.items() for i, d in enumerate(ds)], "doc long, i int, depth int").repartition(3)
    got = {(r.doc, r.i): r for r in numbering.item_marks(df, ["doc"], ["i"]).collect()}
    for k, ds in docs.items():
        for i, (place, siblings) in enumerate(_brute(ds)):
            assert got[k, i].place == place and bool(got[k, i].mark) == siblings
    few = spark.createDataFrame([(1, 0, None), (1, 1, 1), (1, 2, 1), (1, 3, 9), (1, 4, -2), (None, 0, 5)], "doc long, i int, depth int")
    assert [r.mark for r in numbering.item_marks(few, ["doc"], ["i"]).orderBy(F.col("doc").desc(), "i").collect()] == ["1.", "가.", "나.", "", "2.", ""]
    assert [r.mark for r in numbering.item_marks(few, ["doc"], ["i"], kind="bullets", small_second=True).orderBy(F.col("doc").desc(), "i").collect()] == ["□", "ㅇ", "ㅇ", "ㆍ", "□", "ㆍ"]
    assert numbering.item_marks(few.limit(0), ["doc"], ["i"]).count() == 0


@pytest.mark.parametrize(("text", "bare"), [("□ 1. 개요", "개요"), ("1.5 개요", "5 개요"), ("Ⅳ) 끝", "끝"), ("- x", "x"), ("2.3.1. y", "y"), ("글", "글")])
def test_chapter_titles(spark, text, bare):
    assert spark.range(1).select(marks.bare_chapter_title(F.lit(text)).alias("t")).first().t == bare


def test_image_sizes(spark):
    files = {b"\x89PNG": None, b"\xff\xd8": None, b"\xff\xd8\xff\xe0\x00\x04ab\xff": None, b"GIF89a\x01\x00\x02": None, b"": None, b"BM" + bytes(16) + b"\x05\0\0\0\xfd\xff\xff\xff": (5, 3), b"\xff\xd8\x00\xff\xc0\x00\x11\x08\x00\x07\x00\x09xx": (9, 7), None: None}
    rows = spark.createDataFrame([(x,) for x in files], "c binary").select("c", sniff.image_size(F.col("c")).alias("s")).collect()
    for r in rows:
        want = files[bytes(r.c) if r.c is not None else None]
        assert (None if r.s is None or r.s.width is None else (r.s.width, r.s.height)) == want, r


def test_footnotes_and_sections(spark):
    rows = spark.createDataFrame([("a\r\nb",), ("x\n[^1]: p\n[^1]:  q \n [^2]: no\n[^3]:",), ("[^ ]: no",), ("",), (None,)], "t string")
    got = {r.t: r for r in rows.select("t", markdown.footnotes(F.col("t")).alias("n"), markdown.without_footnotes(F.col("t")).alias("w")).collect()}
    assert got["a\r\nb"].w == "a\r\nb" and got["a\r\nb"].n == [] and got[""].w == "" and got[None].n is None and got[None].w is None and got["[^ ]: no"].n == []
    noted = got["x\n[^1]: p\n[^1]:  q \n [^2]: no\n[^3]:"]
    assert [tuple(x) for x in noted.n] == [("1", "q"), ("3", "")] and noted.w == "x\n [^2]: no"
    names = ["section10.xml", "a/Section2.xml", "b/section2.xml", "x"]
    df = spark.createDataFrame([(x,) for x in names], "p string")
    assert [r.p for r in df.orderBy(text.section_number(F.col("p")), "p").collect()] == ["a/Section2.xml", "b/section2.xml", "section10.xml", "x"]
    fonts = spark.createDataFrame([("굴림체 ",), ("굴림",), ("새굴림체",), (None,)], "f string").select(layout.is_fixed_pitch(F.col("f")).alias("x"))
    assert [r.x for r in fonts.collect()] == [True, False, False, False]
    errors = spark.createDataFrame([(None,), ("섹션 없음",), ("크기 초과",)], "m string").select(text.error_class(F.col("m")).alias("c"))
    assert [r.c for r in errors.collect()] == ["PARSE_ERROR", "NO_SECTIONS", "DECOMPRESSION_BOMB"]


def test_boxes_and_steps(spark):
    items = [(1, 0, 5, 5, 10, 0, 0, "z"), (1, 1, 1, 9, 2, 3, 8, ""), (1, 2, 0, 0, 1, 1, 6, "b"), (1, 3, 0, 0, 1, 1, 6, "c"), (1, 4, 0, 0, 1, 1, 8, "d"), (2, 0, 1, 1, 1, 0, 0, "e")]
    df = spark.createDataFrame(items, "doc long, item_id int, x int, y int, w int, h int, font_size int, font_name string")
    assert [tuple(r) for r in geometry.bounding_boxes(df, ["doc"]).orderBy("doc").collect()] == [(1, 0, 0, 15, 12, 6, "b"), (2, 1, 1, 1, 0, None, None)]
    assert geometry.bounding_boxes(df.limit(0), ["doc"]).count() == 0
    steps = [(1, 0, [0.1, 0.9]), (1, 1, [0.1, 0.9]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 2.0]), (1, 4, [0.5, 0.4, 0.1]), (1, 5, [0.1, 0.1, 0.8]), (2, 0, [0.9, 0.1]), (3, 0, None)]
    df = spark.createDataFrame(steps, "doc long, step int, scores array<double>")
    (row,) = geometry.decoded_steps(df, ["doc"], ["a"]).collect()
    assert row.doc == 1 and row.text == "aa " and row.confidence == pytest.approx((0.9 + 1 / (1 + 2.718281828459045**-2) + 0.8) / 3)
