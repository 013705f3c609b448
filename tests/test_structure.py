import pandas as pd
from pyspark.sql import functions as F

from quire.operators import structure
from quire.sources import hwpx_write, office


def test_captions(spark):
    rows = [("paragraph", "표 1. 예산", 1), ("table", None, 1), ("table", None, 1), ("paragraph", "<표 2> 인력", 1), ("table", None, 1), ("paragraph", "표지", 1), ("table", None, 2)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, block_id int, type string, text string, page_number int")
    got = [(r.block_id, r.caption) for r in structure.captions(df).orderBy("block_id").collect()]
    assert got == [(1, "표 1. 예산"), (2, "<표 2> 인력"), (4, None), (5, None), (6, None)]


def test_pairs(spark):
    texts = ["구분: 가", "담당자: 김", "시각: 14:30", "구분: 혼자", "글"]
    df = spark.createDataFrame([(1, i, "paragraph", t) for i, t in enumerate(texts)], "doc_id long, block_id int, type string, text string")
    assert [(r.table_id, r.r, r.c, r.text) for r in structure.pair_tables(df).orderBy("table_id", "r", "c").collect()] == [(0, 0, 0, "구분"), (0, 0, 1, "가"), (0, 1, 0, "담당자"), (0, 1, 1, "김")]


def test_false_tables(spark):
    grids = {1: [["성명", "분야"], ["○ 김", ""]], 2: [["ㅇ 중점 사항"]], 3: [["a", "b", "c"]], 4: [["2024", "12", "x"]]}
    df = spark.createDataFrame([(t, r, c, x) for t, rows in grids.items() for r, row in enumerate(rows) for c, x in enumerate(row)], "t long, r int, c int, text string")
    assert {r.t for r in structure.false_tables(df, ["t"]).collect()} == {2, 3}


def test_charts(spark):
    got = structure.parse_chart("type: bar\ncat: 가, 나\n매출: 1,000, 20, 3\n비용: 5")
    assert got == {"type": "bar", "categories": ["가", "나", "항목 3"], "series": [{"name": "매출", "values": [1000.0, 20.0, 3.0]}, {"name": "비용", "values": [5.0, 0.0, 0.0]}]}
    assert structure.parse_chart("a: x") is None and structure.parse_chart(None) is None
    df = spark.createDataFrame([("a: 1",), (None,)], "t string").select(structure.charts("t").alias("c"))
    assert [len(r.c.series or []) for r in df.collect()] == [1, 0]


def test_blanks_and_alignment():
    assert structure.fill_blanks("일반(  )통 □남 □여 (한자：   )", {"일반통": "3", "남": "v", "여": "", "한자": "金"}) == "일반(3)통 ☑남 □여 (한자：金)"
    assert structure.align_units(["a", "b", "c"], ["a", "x", "c"]) == [(0, 0), (1, 1), (2, 2)]
    assert structure.align_units(["first text", "second text", "z"], ["second text!", "z"]) == [(0, None), (1, 0), (2, 1)]
    assert structure.align_units(["a"] * 3, ["a"] * 2, most=1) == [(0, 0), (1, 1), (2, None)]
    assert structure.align_units([], ["q"]) == [(None, 0)]


def test_written_numbers(spark):
    cases = {1: "일", 10: "십", 11: "십일", 21: "이십일", 10_305: "만삼백오", 99_999: "구만구천구백구십구", 0: "0", 100_000: "100000"}
    rows = spark.createDataFrame([(k,) for k in cases], "n int").select("n", structure.written_number(F.col("n")).alias("w")).collect()
    assert {r.n: r.w for r in rows} == cases


def test_hwpx_round_trip(spark):
    text = "# 제목 & 끝\n\n**굵은** 글\n\n- 하나\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n"
    data = hwpx_write.markdown_to_hwpx(text)
    assert office.validate_hwpx(data) == [] and data == hwpx_write.markdown_to_hwpx(text)
    got = office.decode(data, "hwpx")
    assert [b["text"] for b in got["blocks"]] == ["제목 & 끝", "굵은 글", "- 하나", None]
    assert [c["text"] for c in got["cells"]] == ["a", "b|c", "1", "2"]
    df = spark.createDataFrame(pd.DataFrame({"t": [text, None]})).select(F.length(hwpx_write.generated_hwpx("t")).alias("n"))
    assert all(r.n > 500 for r in df.collect())
