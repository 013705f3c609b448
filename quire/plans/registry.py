"""All queries over the driver's tables, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fields, formula, marks, numbers, sniff, text
from quire.operators import blocks, chunks, compare, forms, geometry, layout, lint, markdown, numbering as paragraph_numbering, quality, redact, structure, style, tables
from quire.plans import fixtures as fx
from quire.sources import hwpx_write, office

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space as the text functions see it, for RE2.
_W = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = rf"^{_W}+|{_W}+$"

_BLOCKS_SQL = f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS block_id, 'paragraph' AS type, t AS text
FROM (SELECT doc_id, line, regexp_replace(x, '{_TRIM}', '', 'g') AS t
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents))
WHERE t <> ''
"""


@_query(f"SELECT doc_id, block_id::INT AS block_id, type, text FROM ({_BLOCKS_SQL})")
def blocks_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.paragraph_blocks(_table(spark, sf_dir, "documents")).drop("level")


_HTML_SQL = r"""
SELECT page_id AS doc_id, i::INT AS block_id, lower(regexp_extract(b, '^<(\w+)', 1)) AS tag FROM (
  SELECT page_id, unnest(bs) AS b, unnest(range(len(bs))) AS i FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'),
      '(?is)<h1\b[^>]*>.*?</h1\s*>|<p\b[^>]*>.*?</p\s*>|<li\b[^>]*>.*?</li\s*>') AS bs FROM pages))
"""


@_query(f"SELECT doc_id, block_id, CASE WHEN tag = 'h1' THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS type, CASE WHEN tag = 'h1' THEN 1 ELSE 0 END::INT AS level FROM ({_HTML_SQL})")
def blocks_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.html_blocks(_table(spark, sf_dir, "pages")).drop("text").withColumn("level", F.coalesce("level", F.lit(0)))


@_query()
def outline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.outline(blocks.html_blocks(_table(spark, sf_dir, "pages")))


_QUALITY_SQL = r"""
SELECT doc_id, lang, length(b) AS n, length(b) - length(regexp_replace(b, '[\x{AC00}-\x{D7A3}]', '', 'g')) AS hangul,
       length(b) - length(regexp_replace(b, '[\x00-\x1F\x7F\x{80}-\x{9F}]', '', 'g')) AS control, length(b) - length(regexp_replace(b, '\x{FFFD}', '', 'g')) AS replacement,
       length(b) - length(regexp_replace(b, '[\x{E000}-\x{F8FF}]', '', 'g')) AS private
FROM (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[\x20\t\n\r]', '', 'g') AS b FROM documents)
"""
_REASON_SQL = "CASE WHEN n < 20 THEN 'low_text' WHEN private / greatest(n, 1) >= 0.2 THEN 'high_pua' WHEN control / greatest(n, 1) >= 0.05 THEN 'high_control' WHEN replacement / greatest(n, 1) >= 0.05 THEN 'high_replacement' END"


@_query(f"SELECT doc_id, n AS text_chars, round(hangul / greatest(n, 1), 6) AS hangul_ratio, round(control / greatest(n, 1), 6) AS control_ratio, ({_REASON_SQL}) AS ocr_reason, ({_REASON_SQL}) IS NOT NULL AS needs_ocr FROM ({_QUALITY_SQL})")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.page_quality(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.col("text_chars").cast("long"), *[F.round(c, 6).alias(c) for c in ("hangul_ratio", "control_ratio")], "ocr_reason", "needs_ocr")


@_query(f"""SELECT lang, count(*) AS total_pages, sum(n)::BIGINT AS total_text_chars, round(avg(hangul / greatest(n, 1)), 6) AS avg_hangul_ratio, round(avg(control / greatest(n, 1)), 6) AS avg_control_ratio,
round(avg(replacement / greatest(n, 1)), 6) AS avg_replacement_ratio, round(avg(private / greatest(n, 1)), 6) AS avg_pua_ratio, count(*) FILTER (n < 20) AS low_text_pages,
count(*) FILTER (private / greatest(n, 1) >= 0.2) AS high_pua_pages, count(*) FILTER (({_REASON_SQL}) IS NOT NULL) / count(*) >= 0.3 AS needs_ocr FROM ({_QUALITY_SQL}) GROUP BY lang""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_summary(quality.page_quality(_table(spark, sf_dir, "documents"), ["doc_id", "lang"]), "lang")


@_query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{80}}-\x{{9F}}]', '', 'g'), '{_W}+', ' ', 'g'), '{_TRIM}', '', 'g') AS cleaned FROM documents""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.squeeze(text.strip_control(F.col("text"))).alias("cleaned"))


@_query("""SELECT page_id, CASE WHEN strlen(html) < 4 THEN 'unknown' WHEN html LIKE 'PK' || chr(3) || chr(4) || '%' THEN 'hwpx' WHEN html LIKE '\\%PDF%' ESCAPE '\\' THEN 'pdf'
WHEN regexp_matches(html, '^\\s*<\\?xml') AND contains(html[1:512], '<HWPML') THEN 'hwpml' ELSE 'unknown' END AS format FROM pages""")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", sniff.detect_format(F.encode("html", "UTF-8")).alias("format"))


_RANGES_SQL = fx.values_sql(fx.RANGES, "spec, max_pages")


@_query(f"""SELECT DISTINCT case_id::BIGINT AS case_id, p::INT AS page FROM (SELECT case_id, unnest(range(lo, hi + 1)) AS p FROM (
SELECT case_id, CASE WHEN regexp_matches(x, '^\\d+\\s*-\\s*\\d+$') THEN greatest(1, regexp_extract(x, '^(\\d+)', 1)::INT) ELSE try_cast(regexp_extract(x, '^\\d+', 0) AS INT) END AS lo,
CASE WHEN regexp_matches(x, '^\\d+\\s*-\\s*\\d+$') THEN least(max_pages, regexp_extract(x, '(\\d+)$', 1)::INT) ELSE try_cast(regexp_extract(x, '^\\d+', 0) AS INT) END AS hi, max_pages
FROM (SELECT case_id, max_pages, trim(unnest(string_split(spec, ','))) AS x FROM {_RANGES_SQL})) WHERE lo >= 1 AND hi <= max_pages AND lo <= hi)""")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.page_range(fx.numbered(spark, fx.RANGES, "spec string, max_pages int")).select("case_id", "page")


_PAGED_SQL = f"SELECT doc_id, block_id, text, CASE WHEN block_id % 7 <> 3 THEN block_id // 20 + 1 END AS page_number FROM ({_BLOCKS_SQL})"


@_query(f"""WITH b AS ({_PAGED_SQL}),
f AS (SELECT doc_id, arg_min(page_number, block_id) FILTER (page_number IS NOT NULL) AS first_page FROM b GROUP BY doc_id),
a AS (SELECT doc_id, block_id, text, coalesce(last_value(page_number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_id), first_page) AS page FROM b JOIN f USING (doc_id) WHERE first_page IS NOT NULL),
s AS (SELECT doc_id, unnest(range(min(page), max(page) + 1)) AS page FROM a GROUP BY doc_id)
SELECT doc_id, page::INT AS page_number, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_id), '') AS markdown FROM s LEFT JOIN a USING (doc_id, page) GROUP BY doc_id, page""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks.paragraph_blocks(_table(spark, sf_dir, "documents"))
    paged = own.withColumn("page_number", F.when(F.col("block_id") % 7 != 3, (F.col("block_id") / 20).cast("int") + 1))
    return blocks.page_markdown(paged)


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines: every customer's nation as a header above its name, a document for each region."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").cast("long").alias("doc_id"), "c_custkey", F.concat(F.lit("1. "), F.col("n_name")).alias("head"), F.col("c_name").alias("body"))
    both = rows.select("doc_id", F.explode(F.array(F.struct((F.col("c_custkey") * 2).alias("block_id"), F.col("head").alias("text")), F.struct((F.col("c_custkey") * 2 + 1).alias("block_id"), F.col("body").alias("text")))).alias("b"))
    return both.select("doc_id", "b.block_id", F.lit("paragraph").alias("type"), "b.text")


@_query("""WITH b AS (SELECT n_regionkey AS doc_id, unnest([c_custkey * 2, c_custkey * 2 + 1]) AS block_id, unnest(['1. ' || n_name, c_name]) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS n, row_number() OVER (PARTITION BY doc_id, text ORDER BY block_id) AS k, regexp_matches(text, '^\\d+\\.\\s') AND length(text) <= 40 AS cand FROM b)
SELECT doc_id::BIGINT AS doc_id, block_id::BIGINT AS block_id, text FROM k WHERE NOT cand OR n < 3 OR k = 1""")
def dedupe_running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.dedupe_running_headers(_headed(spark, sf_dir)).select("doc_id", F.col("block_id").cast("long").alias("block_id"), "text")


@_query("""WITH b AS (SELECT n_regionkey AS doc_id, c_custkey AS page, c_nationkey AS block, '- ' || c_custkey || ' -' AS foot FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM b GROUP BY doc_id)
SELECT b.doc_id::BIGINT AS doc_id, page::BIGINT AS page, u AS block_id FROM (SELECT doc_id, page, unnest([0, 1]) AS u FROM b) b JOIN n USING (doc_id) WHERE u = 0 OR pages < 3""")
def header_footer_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("c_custkey").cast("long").alias("page"), "c_name")
    body = rows.select("doc_id", "page", F.lit(0).alias("block_id"), F.col("c_name").alias("text"), F.lit(400.0).alias("y"), F.lit(20.0).alias("height"), F.lit(800.0).alias("page_height"))
    foot = rows.select("doc_id", "page", F.lit(1).alias("block_id"), F.concat(F.lit("- "), F.col("page").cast("string"), F.lit(" -")).alias("text"), F.lit(30.0).alias("y"), F.lit(10.0).alias("height"), F.lit(800.0).alias("page_height"))
    return blocks.remove_header_footer(body.unionByName(foot)).select("doc_id", "page", "block_id")


@_query("""WITH w AS (SELECT p_brand, p_size, sum(1) AS w FROM part GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, sum(w) OVER (PARTITION BY p_brand) AS total FROM w)
SELECT p_brand, min(p_size) AS median FROM r WHERE upto > floor(total / 2) GROUP BY p_brand""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.weighted_median(_table(spark, sf_dir, "part").withColumn("w", F.lit(1)), "p_brand", "p_size", "w")


@_query("""WITH w AS (SELECT p_brand, p_size, count(*) AS w FROM part GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, sum(w) OVER (PARTITION BY p_brand) AS total FROM w),
m AS (SELECT p_brand, min(p_size) AS median FROM r WHERE upto > floor(total / 2) GROUP BY p_brand)
SELECT p_partkey AS block_id, CASE WHEN p_size / median >= 1.5 THEN 1 WHEN p_size / median >= 1.3 THEN 2 WHEN p_size / median >= 1.15 THEN 3 ELSE 0 END::INT AS level,
CASE WHEN p_size / median >= 1.15 THEN 'heading' ELSE 'paragraph' END AS type FROM part JOIN m USING (p_brand)""")
def detect_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    medians = blocks.weighted_median(part.withColumn("w", F.lit(1)), "p_brand", "p_size", "w").withColumnRenamed("p_brand", "doc_id")
    own = part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("block_id"), F.lit("paragraph").alias("type"), F.col("p_name").alias("text"), F.lit(None).cast("int").alias("level"), F.col("p_size").alias("font_size"))
    return blocks.detect_headings(own, medians).select("block_id", F.coalesce("level", F.lit(0)).alias("level"), "type")


@_query()
def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.numbered(spark, fx.LABELS, "text string")
    return found.select("case_id", "text", fields.is_label_cell(F.col("text")).alias("is_label"), fields.is_keyword_label(F.col("text")).alias("is_keyword"), fields.normalize_label(F.col("text")).alias("norm"))


@_query()
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = fx.numbered(spark, fx.TYPES, "label string, value string")
    own = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("case_id"), F.lit("연락처").alias("label"), F.col("c_name").alias("value"))
    return forms.form_schema(literal.unionByName(own))


@_query()
def fill_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.numbered(spark, fx.FORMATS, "value string, format string")
    return found.withColumn("filled", fields.format_fill_value(F.col("value"), F.col("format")))


@_query("SELECT * FROM (VALUES (0, '1900-01-01'), (1, '1900-02-28'), (2, '1900-03-01'), (3, '2024-01-15'), (4, '1904-01-01'), (5, NULL), (6, '2024-01-15T18:00:00')) AS v(case_id, iso)")
def date_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.numbered(spark, fx.SERIALS, "serial double, date1904 boolean, kind string")
    return found.select("case_id", numbers.serial_to_iso(F.col("serial"), F.col("date1904"), F.col("kind")).alias("iso"))


@_query("""SELECT n_nationkey AS n, ['가','나','다','라','마','바','사','아','자','차','카','타','파','하','거','너','더','러','머','버','서','어','저','처','커'][n_nationkey + 1] AS hangul,
CASE WHEN n_nationkey < 20 THEN chr(9312 + n_nationkey) ELSE chr(12881 + n_nationkey - 20) END AS circled,
['1','I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI','XXII','XXIII','XXIV'][n_nationkey + 1] AS roman FROM (SELECT n_nationkey::INT AS n_nationkey FROM nation)""".replace("['1','I'", "['0','I'"))
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("int")
    return _table(spark, sf_dir, "nation").select(n.alias("n"), numbers.hangul_ordinal(n).alias("hangul"), numbers.circled_number(n).alias("circled"), numbers.roman_numeral(n).alias("roman"))


def _nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region: a row for each nation, with its key and name."""
    n = _table(spark, sf_dir, "nation")
    rows = n.selectExpr("cast(n_regionkey as long) as table_id", "cast(row_number() over (partition by n_regionkey order by n_nationkey) as int) as r", "cast(n_nationkey as string) as k", "n_name")
    body = rows.select("table_id", "r", F.posexplode(F.array("k", "n_name")).alias("c", "text"))
    head = n.select(F.col("n_regionkey").cast("long").alias("table_id")).distinct().select("table_id", F.lit(0).alias("r"), F.posexplode(F.array(F.lit("key"), F.lit("name"))).alias("c", "text"))
    return body.unionByName(head).select("*", F.lit(1).alias("col_span"), F.lit(1).alias("row_span"))


_NATION_SQL = """SELECT n_regionkey::BIGINT AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS r, n_nationkey, n_name FROM nation"""


@_query(f"SELECT table_id, r, u::INT AS c, CASE WHEN u = 0 THEN n_nationkey::VARCHAR ELSE n_name END AS text, false AS is_header FROM ({_NATION_SQL}), (SELECT unnest([0, 1]) AS u) UNION ALL SELECT DISTINCT n_regionkey::BIGINT, 0, u, ['key', 'name'][u + 1], true FROM nation, (SELECT unnest([0, 1]) AS u)")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.build_grid(_nation_cells(spark, sf_dir), ["table_id"]).select("table_id", "r", "c", "text", "is_header")


@_query(f"SELECT table_id, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY r) AS markdown FROM ({_NATION_SQL}) GROUP BY table_id")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_markdown(tables.build_grid(_nation_cells(spark, sf_dir), ["table_id"]), ["table_id"])


@_query(f"SELECT table_id, 'key / name' || chr(10) || string_agg(n_nationkey || ' / ' || n_name, chr(10) ORDER BY r) AS text FROM ({_NATION_SQL}) GROUP BY table_id")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_text(tables.build_grid(_nation_cells(spark, sf_dir), ["table_id"]), ["table_id"])


@_query(f"SELECT table_id, r, u::INT AS c, CASE WHEN u = 0 THEN n_nationkey::VARCHAR ELSE n_name END AS text FROM ({_NATION_SQL}), (SELECT unnest([0, 1]) AS u) UNION ALL SELECT DISTINCT n_regionkey::BIGINT, 0, u, ['key', 'name'][u + 1] FROM nation, (SELECT unnest([0, 1]) AS u)")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parse_markdown_rows(table_markdown(spark, sf_dir), ["table_id"])


@_query("""SELECT o_orderkey AS table_id, c::INT AS c, CASE WHEN c = 1 AND o_orderkey % 3 = 0 THEN 'modified' WHEN c = 2 AND o_orderkey % 5 = 0 THEN 'removed' WHEN c = 3 THEN 'added' ELSE 'unchanged' END AS type
FROM orders, (SELECT unnest([0, 1, 2, 3]) AS c)""")
def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    cells = lambda *x: o.select("table_id", F.lit(0).alias("r"), F.posexplode(F.array(*x)).alias("c", "text")).where("text is not null")
    key = F.col("table_id").cast("string")
    before = cells(key, "s", "p")
    after = cells(key, F.when(F.col("table_id") % 3 == 0, F.concat("s", F.lit("*"))).otherwise(F.col("s")), F.when(F.col("table_id") % 5 != 0, F.col("p")), F.lit("new"))
    return tables.cell_diff(before, after, ["table_id"]).select("table_id", "c", "type")


def _customer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form for each customer: name, number and segment beside their labels."""
    c = _table(spark, sf_dir, "customer")
    rows = F.array(*[F.struct(F.lit(i).alias("r"), F.lit(label).alias("label"), v.cast("string").alias("value")) for i, (label, v) in enumerate((("성명", F.col("c_name")), ("고객 번호", F.col("c_custkey")), ("소속:", F.col("c_mktsegment"))))])
    flat = c.select(F.col("c_custkey").cast("long").alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", F.lit(0).alias("table_id"), "x.r", F.posexplode(F.array("x.label", "x.value")).alias("c", "text"))
    return flat


@_query("""SELECT c_custkey::BIGINT AS doc_id, ['성명', '고객 번호', '소속'][i + 1] AS label, CASE i WHEN 0 THEN c_name WHEN 1 THEN c_custkey::VARCHAR ELSE c_mktsegment END AS value, i::INT AS r
FROM customer, (SELECT unnest([0, 1, 2]) AS i)""")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.table_fields(_customer_forms(spark, sf_dir), ["doc_id"]).select("doc_id", "label", "value", "r")


def _given(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("성명", 0, 0, "김"), ("고객번호입력", 1, 0, "7"), ("소속", 2, 0, "가"), ("소속", 2, 1, "나"), ("주소지", 3, 0, "서울")], "key string, key_no int, value_index int, value string")


@_query("""SELECT c_custkey::BIGINT AS doc_id, ['성명', '고객 번호', '소속'][i + 1] AS label, CASE i WHEN 0 THEN '성명' WHEN 2 THEN '소속' END AS matched_key FROM customer, (SELECT unnest([0, 1, 2]) AS i)""")
def key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.table_fields(_customer_forms(spark, sf_dir), ["doc_id"]).select("doc_id", "label")
    return forms.match_keys(found, _given(spark).select("key", "key_no").distinct())


@_query("SELECT * FROM (VALUES ('고객번호입력'), ('주소지')) AS v(key)")
def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.unmatched(_given(spark).select("key").distinct(), key_match(spark, sf_dir))


@_query("SELECT '성명' AS key FROM customer HAVING count(*) >= 2")
def unique_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.unique_guard(key_match(spark, sf_dir), _given(spark))[1]


@_query()
def redact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fx.numbered(spark, fx.PERSONAL, "text string").select((-1 - F.col("case_id")).alias("doc_id"), "text"))
    return own.select("doc_id", F.explode(redact.redacted("text")["hits"]).alias("h")).select("doc_id", "h.*")


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, length(text) AS n FROM documents""")
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", redact.redacted("text", ("email",)).alias("r"))
    return found.select("doc_id", F.size("r.hits").cast("long").alias("emails"), F.length("r.text").cast("long").alias("n"))


@_query()
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fx.numbered(spark, fx.NOTATION, "text string").select((-1 - F.col("case_id")).alias("doc_id"), "text"))
    return lint.findings(own, ["doc_id"])


@_query(r"""WITH f AS (SELECT doc_id, len(regexp_extract_all(text, '[—–―]')) AS n FROM documents) SELECT doc_id, n AS total, 0::BIGINT AS errors FROM f WHERE n > 0""")
def lint_dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.summary(lint.findings(_table(spark, sf_dir, "documents"), ["doc_id"]).where("rule = 'AI_EM_DASH'"), ["doc_id"])


def _conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a heading, its turns as headings by role with their text below."""
    turns = _table(spark, sf_dir, "conversations")
    head = turns.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.lit(-1).cast("long").alias("k"), F.lit("heading").alias("type"), F.concat(F.lit("conversation "), F.col("doc_id").cast("string")).alias("text"), F.lit(1).alias("level"))
    role = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2).alias("k"), F.lit("heading").alias("type"), F.col("role").alias("text"), F.lit(2).alias("level"))
    said = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + 1).alias("k"), F.lit("table").alias("type"), "text", F.lit(None).cast("int").alias("level"))
    return head.unionByName(role).unionByName(said).withColumnRenamed("k", "block_id").withColumn("block_id", F.col("block_id").cast("int"))


@_query(f"""WITH b AS (SELECT DISTINCT conv_id AS doc_id, -1 AS k, 'heading' AS type, '# conversation ' || conv_id AS text, '' AS crumb FROM conversations
UNION ALL SELECT conv_id, turn * 2, 'heading', '## ' || role, 'conversation ' || conv_id FROM conversations
UNION ALL SELECT conv_id, turn * 2 + 1, 'table', regexp_replace(text, '{_TRIM}', '', 'g'), 'conversation ' || conv_id || ' > ' || role FROM conversations WHERE regexp_replace(coalesce(text, ''), '{_TRIM}', '', 'g') <> '')
SELECT doc_id, 'c' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY k)::VARCHAR, 4, '0') AS chunk_id, type, crumb, text, k::INT AS first_block FROM b""")
def chunks_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.chunks(_conversation_blocks(spark, sf_dir))
    return found.select("doc_id", "chunk_id", "type", F.array_join("breadcrumb", " > ").alias("crumb"), "text", "first_block")


@_query()
def chunks_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.chunks(blocks.html_blocks(_table(spark, sf_dir, "pages")))
    return found.select("doc_id", "chunk_id", "type", F.array_join("breadcrumb", " > ").alias("crumb"), "text", "first_block", "last_block")


@_query()
def list_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey as long) as doc_id", "cast(row_number() over (partition by n_regionkey order by n_nationkey) as int) as block_id", "n_name")
    own = n.select("doc_id", "block_id", F.lit("paragraph").alias("type"), F.concat(F.col("block_id").cast("string"), F.lit(". "), F.col("n_name")).alias("text"))
    return blocks.list_chains(own).select("doc_id", "block_id", "family", "ordinal", "chain")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents, and the same with every fifth left out, every seventh ending changed."""
    own = blocks.paragraph_blocks(_table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "pair_id")
    after = own.where("block_id % 5 <> 4").withColumn("text", F.when(F.col("block_id") % 7 == 6, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    return own, after


@_query()
def block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_stats(compare.diff_blocks(*_versions(spark, sf_dir)))


@_query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    a, b = t.select("conv_id", "turn", F.col("text").alias("a")), t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    found = a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", compare.diffed_words("a", "b").alias("d"))
    count = lambda k: F.size(F.filter("d", lambda x: x["type"] == k)).alias(k)
    return found.select("conv_id", "turn", count("equal"), count("insert"), count("delete"))


@_query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(CASE WHEN a.n_name = b.n_name THEN 1.0 ELSE 1.0 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)) END, 6) AS similarity
FROM nation a JOIN nation b USING (n_regionkey)""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").select("a", "b", F.round(text.normalized_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


#: Outline lines that the style rules judge.
_OUTLINE = ("○ 빈집 정비가 시급하다", "⇒ 보급해야 한다", "| a | b |", "# 제목", "- 사람이 아니라 마음", "> 시설을 정비하고 인력을 늘려 안전을 높이고자 함.", "○ 왜 그런가?", "2026년 7월 시행")


@_query()
def style_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fx.numbered(spark, _OUTLINE, "text string").select((-1 - F.col("case_id")).alias("doc_id"), "text"))
    return style.findings(own, ["doc_id"])


@_query("""SELECT n_nationkey AS id, round(len(n_name) - len(replace(n_name, ' ', '')), 6)::DOUBLE AS blanks FROM nation""")
def blank_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks are half the font size wide: their count from the widths of texts with and without them."""
    n = _table(spark, sf_dir, "nation")
    width = layout.measured("n_name", 1.0) - layout.measured(F.replace(F.col("n_name"), F.lit(" "), F.lit("")), 1.0)
    return n.select(F.col("n_nationkey").alias("id"), F.round(width * 2, 6).alias("blanks"))


@_query()
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(layout.measured("text", 1000, 95), 3).alias("width"))


@_query()
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", layout.wrapped_lines("text", 42_000, 40_000, 1000, 95).alias("lines"))


@_query("""SELECT conv_id, turn, '# ' || role AS head, len(regexp_extract_all(text, '\\S+')) AS words FROM conversations""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a markdown text of a heading and a code block, parsed again."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("# "), "role", F.lit("\n~~~\n"), F.coalesce("text", F.lit("")), F.lit("\n~~~")).alias("md"))
    found = markdown.parsed_blocks(t, ["conv_id", "turn"], "md").groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("type") == "heading", F.concat(F.lit("# "), "text"))).alias("head"), F.max(F.when(F.col("type") == "code_block", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))).cast("long").alias("words"),
    )
    return found


@_query()
def print_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(markdown.rendered_html("text", "official", "draft")).alias("n"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as text on a page for each region: two columns of rows."""
    n = _table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey as long) as doc_id", "1 as page", "cast(n_nationkey as int) as item_id", "n_name as text", "cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int) as k")
    return n.select("doc_id", "page", "item_id", "text", (50.0 + 250.0 * (F.col("k") / 3).cast("int")).alias("x"), (700.0 - 100.0 * (F.col("k") % 3)).alias("y"), F.lit(100.0).alias("w"), F.lit(10.0).alias("h"))


@_query("SELECT n_regionkey::BIGINT AS doc_id, n_nationkey::INT AS item_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS read_no FROM nation")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.reading_order(_placed(spark, sf_dir)).select("doc_id", "item_id", "read_no")


@_query("""SELECT doc_id, (k % 3)::INT AS r, (k // 3)::INT AS c, n_name AS text FROM (SELECT n_regionkey::BIGINT AS doc_id, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)""")
def aligned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.aligned_cells(_placed(spark, sf_dir)).select("doc_id", "r", "c", "text")


@_query("""SELECT n_nationkey::INT AS item_id, (k // 3)::INT AS c FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)""")
def items_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _placed(spark, sf_dir)
    pages = items.select("doc_id", "page").distinct()
    cells = pages.select("doc_id", "page", F.explode(F.array(*[F.struct(F.lit(0).alias("r"), F.lit(i).alias("c"), F.lit(250.0 * i).alias("x1"), F.lit(0.0).alias("y1"), F.lit(250.0 * (i + 1)).alias("x2"), F.lit(800.0).alias("y2")) for i in range(3)])).alias("s")).select("doc_id", "page", "s.*")
    return geometry.items_in_cells(items, cells).select("item_id", "c")


@_query("SELECT n_regionkey::BIGINT AS table_id, count(*)::BIGINT AS n FROM nation GROUP BY ALL")
def captioned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as captions that each come before a table, regions as documents: every caption is taken once."""
    n = _table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey as long) as doc_id", "cast(n_nationkey as int) as k", "n_name")
    rows = n.select("doc_id", F.explode(F.array(F.struct((F.col("k") * 2).alias("block_id"), F.lit("paragraph").alias("type"), F.concat(F.lit("Table 1. "), "n_name").alias("text")), F.struct((F.col("k") * 2 + 1).alias("block_id"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("text")))).alias("b"))
    found = structure.captions(rows.select("doc_id", "b.*", F.lit(1).alias("page_number")))
    return found.where("type = 'table' and caption like 'Table 1. %'").groupBy(F.col("doc_id").alias("table_id")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT n_nationkey::INT AS n, ['0','일','이','삼','사','오','육','칠','팔','구','십','십일','십이','십삼','십사','십오','십육','십칠','십팔','십구','이십','이십일','이십이','이십삼','이십사'][n_nationkey + 1] AS words FROM nation")
def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("int")
    return _table(spark, sf_dir, "nation").select(n.alias("n"), structure.written_number(n).alias("words"))


@_query("SELECT conv_id, turn, 'hwpx' AS format, 0::BIGINT AS issues FROM conversations")
def generated_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn written as a package, sniffed, and read again."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", hwpx_write.generated_hwpx(F.concat(F.lit("# "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")))).alias("content"))
    parsed = office.parse_files(t)
    return parsed.select("conv_id", "turn", "format", F.when(F.col("error").isNull() & (F.size("blocks") > 0), 0).otherwise(1).cast("long").alias("issues"))


@_query("SELECT n_regionkey::BIGINT AS table_id FROM nation WHERE false")
def false_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of nations have headed columns: none is taken for a box of text."""
    return structure.false_tables(tables.build_grid(_nation_cells(spark, sf_dir), ["table_id"]), ["table_id"])


#: Letters a to z as Hangul syllables, so that rules for Hangul meet whole documents.
_LETTERS, _HANGUL = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"
_HANGUL_SQL = f"translate(lower(coalesce(text, '')), '{_LETTERS}', '{_HANGUL}')"


def _hangul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower(F.coalesce("text", F.lit(""))), _LETTERS, _HANGUL).alias("text"))


@_query("SELECT doc_id, replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvw', '●■□⬧⧫◆❖⬥·•⚪○☜✔☑➔✂✡↓①⑳한' || chr(61472)), 'x', '(인)') AS shown FROM documents")
def private_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose letters are private-use characters, w an unknown one."""
    codes = [0xF06C, 0xF06E, 0xF06F, 0xF073, 0xF074, 0xF075, 0xF076, 0xF077, 0xF09E, 0xF09F, 0xF0A1, 0xF0A2, 0xF045, 0xF0FC, 0xF0FE, 0xF0E8, 0xF022, 0xF059, 0xF003B, 0xF02B1, 0xF02C4, 0xF03EF, 0xF020, 0xF012B]
    private = F.translate(F.coalesce("text", F.lit("")), _LETTERS[: len(codes)], "".join(map(chr, codes)))
    return _table(spark, sf_dir, "documents").select("doc_id", text.map_private(private).alias("shown"))


_TRIMMED = lambda x: f"regexp_replace({x}, '{_TRIM}', '', 'g')"
_PREV, _MARK = "split_part(acc, chr(1), -1)", text.MARKER
_MERGE_SQL = rf"""
SELECT doc_id, replace(list_reduce(string_split(x, chr(10)), lambda acc, l: CASE
  WHEN regexp_matches({_PREV}, '^#{{1,6}}\s') OR regexp_matches(l, '^#{{1,6}}\s') OR regexp_matches({_TRIMMED("l")}, '^([|]|---)') THEN acc || chr(1) || l
  WHEN ends_with({_TRIMMED(_PREV)}, ',') AND {_TRIMMED("l")} <> '' THEN acc || chr(10) || l
  WHEN starts_with({_TRIMMED("l")}, '(※') THEN acc || ' ' || {_TRIMMED("l")}
  WHEN regexp_matches({_PREV}, '[가-힣·,\-]\z') AND regexp_matches(l, '^[가-힣(]') AND NOT regexp_matches({_TRIMMED("l")}, '{_MARK}') AND NOT regexp_matches({_TRIMMED(_PREV)}, '{text.HEADER}') AND NOT regexp_matches({_TRIMMED(_PREV)}, '{_MARK}')
    THEN acc || ' ' || l
  ELSE acc || chr(1) || l END), chr(1), chr(10)) AS merged
FROM (SELECT doc_id, {_HANGUL_SQL} AS x FROM documents)
"""


@_query(_MERGE_SQL)
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in Hangul, their broken lines joined."""
    return _hangul(spark, sf_dir).select("doc_id", text.merge_lines("text").alias("merged"))


_MARKED_SQL = rf"""
WITH b AS (SELECT doc_id, block_id, CASE block_id % 7 WHEN 3 THEN 'table' WHEN 5 THEN 'separator' ELSE 'paragraph' END AS type,
  CASE WHEN block_id % 4 = 1 THEN '□ ' || translate(lower(text), '{_LETTERS}', '{_HANGUL}') ELSE left(translate(lower(text), '{_LETTERS}', '{_HANGUL}'), 4) END AS t FROM ({_BLOCKS_SQL})),
k AS (SELECT *, {_TRIMMED("t")} AS x, type = 'paragraph' AND t <> '' AS plain FROM b),
m AS (SELECT *, plain AND length(x) < 50 AND regexp_matches(x, '^[□■◆◇▶]\s*[가-힣]') AS marked FROM k),
w AS (SELECT *, plain AND NOT marked AND regexp_matches(x, '^[가-힣]{{2,6}}$') AS word, CASE WHEN marked THEN 'heading' ELSE type END AS kind FROM m),
n AS (SELECT *, lag(kind) OVER o AS p, lead(type) OVER o AS q, coalesce(lead(plain AND regexp_matches(x, '^[□■◆○●]')) OVER o, false) AS opens, sum((NOT word)::INT) OVER o AS run FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY block_id)),
f AS (SELECT *, word AND (p IS NULL OR p IN ('table', 'heading', 'separator') OR q IS NULL OR q IN ('table', 'heading') OR opens) AS near FROM n)
SELECT doc_id, block_id::INT AS block_id, CASE WHEN marked THEN 4 WHEN word AND bool_or(near) OVER (PARTITION BY doc_id, run ORDER BY block_id) THEN 3 ELSE 0 END::INT AS level FROM f
"""


@_query(_MARKED_SQL)
def marked_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of whole documents in Hangul, some of them marked, cut to a word, or made tables and separators."""
    own = blocks.paragraph_blocks(_table(spark, sf_dir, "documents"))
    kind, hangul = F.col("block_id") % 7, F.translate(F.lower("text"), _LETTERS, _HANGUL)
    own = own.withColumn("type", F.when(kind == 3, "table").when(kind == 5, "separator").otherwise("paragraph")).withColumn("text", F.when(F.col("block_id") % 4 == 1, F.concat(F.lit("□ "), hangul)).otherwise(F.left(hangul, F.lit(4))))
    return blocks.marker_headings(own.withColumn("font_size", F.lit(10.0))).select("doc_id", "block_id", F.coalesce("level", F.lit(0)).alias("level"))


_ORDERED_SQL = "SELECT o_custkey::BIGINT AS doc_id, o_orderkey::BIGINT AS item_id, o_orderpriority, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS k FROM orders"


def _ordered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer, numbered from 0."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey as long) as doc_id", "cast(o_orderkey as long) as item_id", "o_orderpriority", "cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as k"
    )


@_query(f"""SELECT doc_id, 0 AS r, 0 AS c, 'orders' AS text, 2 AS col_span, 1 AS row_span FROM orders_of GROUP BY doc_id
UNION ALL SELECT doc_id, k + 1, 0, '<' || item_id || '> & "' || k || '"', 1, 1 FROM orders_of UNION ALL SELECT doc_id, k + 1, 1, o_orderpriority || chr(10) || k, 1, 1 FROM orders_of""".replace("orders_of", f"({_ORDERED_SQL})"))
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a merged head for each customer, written as HTML and read back."""
    o = _ordered_items(spark, sf_dir)
    texts = F.array(F.format_string('<%d> & "%d"', "item_id", "k"), F.concat("o_orderpriority", F.lit("\n"), F.col("k").cast("string")))
    body = o.select("doc_id", (F.col("k") + 1).alias("r"), F.posexplode(texts).alias("c", "text")).select("*", F.lit(1).alias("col_span"), F.lit(1).alias("row_span"))
    head = o.select("doc_id").distinct().selectExpr("doc_id", "0 as r", "0 as c", "'orders' as text", "2 as col_span", "1 as row_span")
    return tables.parse_html_cells(tables.to_markdown(tables.build_grid(body.unionByName(head), ["doc_id"]), ["doc_id"]), ["doc_id"])


@_query(f"""WITH o AS ({_ORDERED_SQL}), l AS (SELECT *, (item_id % 4)::INT AS level FROM o),
g AS (SELECT *, sum((level < 1)::INT) OVER w AS g1, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, item_id, concat_ws('.', sum((level = 0)::INT) OVER (PARTITION BY doc_id ORDER BY k), sum((level = 1)::INT) OVER (PARTITION BY doc_id, g1 ORDER BY k),
sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY k), sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY k), 0, 0, 0) AS counters FROM g""")
def paragraph_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _ordered_items(spark, sf_dir).select("doc_id", "item_id", "k", F.lit(1).alias("numbering"), (F.col("item_id") % 4).cast("int").alias("level"))
    counted = paragraph_numbering.paragraph_counters(levels, ["doc_id"], ["k"])
    return counted.select("doc_id", "item_id", F.array_join(F.col("counters").cast("array<string>"), ".").alias("counters"))


@_query(f"SELECT doc_id, item_id, k // 2 AS line_no FROM ({_ORDERED_SQL})")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items a line, their heights out of line by up to 2."""
    items = _ordered_items(spark, sf_dir).selectExpr("doc_id", "1 as page", "item_id", "cast(700 - 10 * floor(k / 2) - item_id % 3 as double) as y")
    return geometry.line_numbers(items).select("doc_id", "item_id", "line_no")


@_query("""SELECT o_orderkey::BIGINT AS item_id FROM (SELECT o_orderkey, o_orderkey % 13 * 100 - 200 AS x, o_orderkey % 11 * 100 - 100 AS y FROM orders)
WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND x BETWEEN -80 AND 680 AND y BETWEEN -80 AND 880""")
def visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on pages of 600 by 800; every seventh has no height, every fifth no width."""
    items = _table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as long) as item_id", "o_orderpriority as text", "cast(o_orderkey % 13 * 100 - 200 as double) as x", "cast(o_orderkey % 11 * 100 - 100 as double) as y",
        "if(o_orderkey % 5 = 0, 0d, 50d) as w", "if(o_orderkey % 7 = 0, 0d, 10d) as h", "600d as page_w", "800d as page_h",
    )
    return geometry.visible_items(items).select("item_id")


@_query("""WITH t AS (SELECT p_partkey::BIGINT AS p_partkey, repeat(substr(p_name, 1, (1 + p_partkey % 9)::INT), (1 + p_partkey % 8)::INT) || p_type AS t FROM part),
l AS (SELECT p_partkey, t, unnest(range(5, 16))::INT AS n FROM t), s AS (SELECT p_partkey, n, length(t) AS size, substr(t, i::INT, n) AS x FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM l)),
c AS (SELECT p_partkey FROM s WHERE size >= 3 * n AND regexp_matches(x, '[a-zA-Z]') GROUP BY p_partkey, n, size, x HAVING count(*) >= 3 AND count(*) * n / size >= 0.6)
SELECT p_partkey, p_partkey IN (SELECT p_partkey FROM c) AS repeats FROM t""")
def high_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "part").selectExpr("cast(p_partkey as long) as p_partkey", "concat(repeat(substr(p_name, 1, cast(1 + p_partkey % 9 as int)), cast(1 + p_partkey % 8 as int)), p_type) as t")
    return texts.select("p_partkey", text.high_repetition("t").alias("repeats"))


_LETTERS_SQL = "SELECT p_partkey::BIGINT AS p_partkey, lower(regexp_replace(p_type, '[^a-zA-Z]', '', 'g')) AS w FROM part"


def _lettered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the letters of their type as one word."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.lower(F.regexp_replace("p_type", "[^a-zA-Z]", "")).alias("w"))


@_query(rf"SELECT p_partkey, '\mathrm{{' || w || '}}_{{' || p_partkey || '}}=\alpha ' || w[1] || '+7' AS latex FROM ({_LETTERS_SQL})")
def cleaned_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas spaced out as a recogniser gives them, with an empty group, a command run into a letter and blanks at the end; the SQL puts together what they stand for."""
    spaced = lambda c: F.regexp_replace(c, "(.)(?=.)", "$1 ")
    raw = F.concat(F.lit(r"\mathrm { "), spaced(F.col("w")), F.lit(" } ^ { } _ { "), spaced(F.col("p_partkey").cast("string")), F.lit(r" }  =  \alpha"), F.left("w", F.lit(1)), F.lit(r" + 7 \quad \, "))
    return _lettered_parts(spark, sf_dir).select("p_partkey", formula.cleaned(raw).alias("latex"))


@_query(f"""SELECT p_partkey, CASE k WHEN 0 THEN least(length(w), 1 + p_partkey % 9) <= 6 WHEN 1 THEN p_partkey % 3 = p_partkey % 2 WHEN 2 THEN p_partkey % 3 = p_partkey % 2 WHEN 3 THEN p_partkey % 5 >= 2 WHEN 4 THEN true ELSE false END AS trivial
FROM (SELECT p_partkey, w, p_partkey // 10 % 6 AS k FROM ({_LETTERS_SQL}))""")
def trivial_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of six kinds, of which the SQL knows which mean something."""
    parts = _lettered_parts(spark, sf_dir).selectExpr("p_partkey", "w", "cast(p_partkey as string) as n", "cast(p_partkey % 3 as string) as a", "cast(p_partkey % 2 as string) as b", "cast(floor(p_partkey / 10) % 6 as int) as k")
    c = F.col
    kinds = [
        F.concat(F.lit(r"\mathrm{"), F.left("w", (1 + c("p_partkey") % 9).cast("int")), F.lit("}")), F.concat(F.lit("C("), c("a"), F.lit(","), c("b"), F.lit(")")),
        F.concat(F.lit(r"\frac{"), c("a"), F.lit("}{"), c("b"), F.lit("}")), F.concat(F.repeat(F.lit("x"), (1 + c("p_partkey") % 5).cast("int")), F.lit("=1")), F.concat(c("n"), F.lit(".5")),
        F.concat(F.lit("d_{"), c("a"), F.lit("}="), c("b")),
    ]
    return parts.select("p_partkey", formula.is_trivial(F.element_at(F.array(*kinds), c("k") + 1)).alias("trivial"))


#: The first 28 Hangul ordinals, for the SQL.
_ORDINALS = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"


@_query(f"""WITH o AS (SELECT *, (item_id // 3 % 8)::INT AS depth FROM ({_ORDERED_SQL})),
p AS (SELECT o.*, (SELECT coalesce(max(q.k), -1) FROM o q WHERE q.doc_id = o.doc_id AND q.k < o.k AND q.depth < o.depth) AS parent FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, depth, parent ORDER BY k) - 1 AS n, count(*) OVER (PARTITION BY doc_id, depth, parent) AS siblings FROM p)
SELECT doc_id, item_id, n::INT AS place, CASE WHEN siblings = 1 THEN '' ELSE CASE WHEN depth IN (4, 5) THEN '(' ELSE '' END ||
CASE depth WHEN 0 THEN (n + 1)::TEXT WHEN 2 THEN (n + 1)::TEXT WHEN 4 THEN (n + 1)::TEXT WHEN 6 THEN chr((9312 + n)::INT) WHEN 7 THEN chr((12910 + n)::INT) ELSE substr('{_ORDINALS}', n + 1, 1) END ||
CASE WHEN depth < 2 THEN '.' WHEN depth < 6 THEN ')' ELSE '' END END AS mark, substr('□○-ㆍ', least(depth, 3) + 1, 1) AS bullet FROM n""")
def item_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _ordered_items(spark, sf_dir).withColumn("depth", (F.floor(F.col("item_id") / 3) % 8).cast("int"))
    marked = paragraph_numbering.item_marks(items, ["doc_id"], ["k"])
    return marked.select("doc_id", "item_id", "place", "mark", marks.bullet_mark(F.col("depth")).alias("bullet"))


@_query(f"""SELECT doc_id, item_id, (k + 3)::TEXT || '. ' || substr('{_ORDINALS}', CASE WHEN k % 3 > 0 THEN 1 + k % 3 ELSE 2 END, 1) || ') ' || chr(9312) || '-' ||
CASE WHEN k + 2 <= 26 THEN chr(98 + k) ELSE chr(96 + (k + 1) // 26) || chr(97 + (k + 1) % 26) END || ' ^9' AS said FROM ({_ORDERED_SQL})""")
def numbering_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = lambda *x: F.array(*[F.lit(v) if isinstance(v, int) else v for v in x])
    k = F.col("k")
    said = marks.expanded(F.lit("^1. ^2) ^3-^4 ^9"), ints(k + 1, k % 3, 0, k + 2), ints(3, 2), ints(0, 8, 1, 5))
    return _ordered_items(spark, sf_dir).select("doc_id", "item_id", said.alias("said"))


@_query("""SELECT p_partkey::BIGINT AS p_partkey, p_name AS title, CASE WHEN n <= 12 THEN chr((8543 + n)::INT) ELSE repeat('Ⅹ', (n // 10)::INT) ||
CASE n % 10 WHEN 0 THEN '' WHEN 4 THEN 'Ⅳ' WHEN 9 THEN 'Ⅸ' ELSE CASE WHEN n % 10 >= 5 THEN 'Ⅴ' ELSE '' END || repeat('Ⅰ', (n % 5)::INT) END END AS roman FROM (SELECT *, 1 + p_partkey % 60 AS n FROM part)""")
def chapter_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles under bullets and numbers of several kinds, and their chapters' numbers."""
    n = (1 + F.col("p_partkey") % 60).cast("int")
    number = F.concat(F.lit("2."), n.cast("string"))
    titles = [F.concat(F.lit("□ "), "p_name"), F.concat(number, F.lit(". "), "p_name"), F.concat(F.lit(" ○ "), marks.chapter_roman(F.least(n, F.lit(12))), F.lit(") "), "p_name"), F.concat(n.cast("string"), F.lit(" . "), "p_name", F.lit(" "))]
    title = F.element_at(F.array(*titles), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), marks.bare_chapter_title(title).alias("title"), marks.chapter_roman(n).alias("roman"))


@_query("SELECT o_orderkey::BIGINT AS o_orderkey, year(o_orderdate) || '. ' || month(o_orderdate) || '. ' || day(o_orderdate) || '.' AS said, round(o_custkey * 7200 / 25.4)::BIGINT AS units, o_orderkey % 2 = 0 AS ended FROM orders")
def letter_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as written, lengths in units and closing words."""
    day = F.col("o_orderdate").cast("date")
    text_ = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("  끝 . ")).otherwise(F.lit("끝.")))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), marks.dotted_date(day).alias("said"), marks.mm_to_units(F.col("o_custkey")).alias("units"), marks.has_end_mark(text_).alias("ended"))


@_query("SELECT p_partkey::BIGINT AS p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 1 + p_partkey % 4000 ELSE -1 END AS width, CASE WHEN p_partkey % 5 < 4 THEN p_size::BIGINT ELSE -1 END AS height FROM part")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of four formats, a BMP's height negative, and files without one, for which there is -1."""
    big = lambda v, n: F.lpad(F.hex(v), 2 * n, "0")
    small = lambda v, n: F.concat(*[F.substring(big(v, n), 2 * k + 1, 2) for k in reversed(range(n))])
    w, h = (1 + F.col("p_partkey") % 4000).cast("long"), F.col("p_size").cast("long")
    headers = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4)), F.concat(F.lit("FFD8FFE00006AABBCCDDFFC400040000FFC2001108"), big(h, 2), big(w, 2), F.lit("0301")),
        F.concat(F.lit("474946383961"), small(w, 2), small(h, 2)), F.concat(F.lit("424D" + "00" * 16), small(w, 4), small((1 << 32) - h, 4)), F.lit("25504446" + "00" * 30),
    ]
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.unhex(F.element_at(F.array(*headers), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("content"))
    sized = files.select("p_partkey", sniff.image_size(F.col("content")).alias("size"))
    return sized.select("p_partkey", *[F.coalesce(F.col(f"size.{c}"), F.lit(-1)).cast("long").alias(c) for c in ("width", "height")])


@_query("""SELECT p_partkey::BIGINT AS p_partkey, CASE k WHEN 0 THEN 'Contents/section' || n || '.xml' WHEN 1 THEN 'Contents/Section' || n || '.xml' WHEN 2 THEN 'a/b/section' || n || '.xml' ELSE '' END AS path,
CASE WHEN k < 3 THEN n ELSE 9007199254740991 END::BIGINT AS number FROM (SELECT *, (p_partkey % 7)::INT AS k, (p_partkey % 900)::BIGINT AS n FROM part)""")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in manifests, some with other slashes, some of no section or leading out."""
    n = (F.col("p_partkey") % 900).cast("string")
    hrefs = [("section", ".xml"), ("\\Contents\\Section", ".xml"), ("//a/b/section", ".xml"), ("../section", ".xml"), ("Contents/header", ".xml"), ("xsection", ".xml.bak"), ("C:\\section", ".xml")]
    href = F.element_at(F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in hrefs]), (F.col("p_partkey") % 7 + 1).cast("int"))
    path = text.section_path(href)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.coalesce(path, F.lit("")).alias("path"), text.section_number(F.coalesce(path, F.lit(""))).cast("long").alias("number"))


@_query("""SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(13) || chr(10) || c_mktsegment ELSE c_name || chr(10) || chr(10) || ' end' END AS body,
CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'b=' || c_mktsegment || ';a=' || c_custkey END AS notes, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_custkey || '.png,x/' || c_nationkey END AS images FROM customer""")
def footnotes_and_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with definitions of footnotes, one of them twice, and images."""
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    noted = F.concat(
        name, F.lit("\r\n[^a]: first\r![p]("), key, F.lit(".png)\n[^b]:"), segment, F.lit(" \n[^a]:  "), key, F.lit("\n![](x/"), F.col("c_nationkey").cast("string"), F.lit(") end")
    )
    own = F.when(key.cast("long") % 3 == 0, F.concat(name, F.lit("\r\n"), segment)).otherwise(noted)
    found = F.array_join(F.transform(markdown.footnotes(own), lambda x: F.concat(x["label"], F.lit("="), x["text"])), ";")
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("c_custkey"), markdown.without_images(markdown.without_footnotes(own)).alias("body"), found.alias("notes"), F.array_join(markdown.image_targets(own), ",").alias("images")
    )


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag"


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order, numbered from 1: line numbers aren't unique."""
    return _table(spark, sf_dir, "lineitem").selectExpr("*", f"cast(row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as int) as i")


@_query(f"""WITH i AS (SELECT l_orderkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}))::INT AS i, (l_partkey % 500)::INT AS x, (l_suppkey % 300)::INT AS y, l_partkey % 3 * 4 AS size, l_returnflag AS font FROM lineitem),
s AS (SELECT doc_id, size, count(*) AS often, max(i) AS last, arg_min(font, i) AS font FROM i WHERE size > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY often DESC, last) AS n FROM s)
SELECT b.doc_id, b.x, b.y, b.width, b.height, coalesce(r.size, -1)::INT AS font_size, coalesce(r.font, '') AS font_name
FROM (SELECT doc_id, min(x) AS x, min(y) AS y, max(x + i) - min(x) AS width, (max(y + CASE WHEN i % 2 = 0 THEN 9 ELSE size END) - min(y))::INT AS height FROM i GROUP BY doc_id) b LEFT JOIN r ON r.doc_id = b.doc_id AND n = 1""")
def item_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as items, every second without height."""
    items = _ordered_lines(spark, sf_dir).selectExpr(
        "cast(l_orderkey as long) as doc_id", "i as item_id", "cast(l_partkey % 500 as int) as x", "cast(l_suppkey % 300 as int) as y", "i as w",
        "if(i % 2 = 0, 9, 0) as h", "cast(l_partkey % 3 * 4 as int) as font_size", "l_returnflag as font_name",
    )
    boxes = geometry.bounding_boxes(items, ["doc_id"])
    return boxes.select("doc_id", "x", "y", "width", "height", F.coalesce("font_size", F.lit(-1)).alias("font_size"), F.coalesce("font_name", F.lit("")).alias("font_name"))


@_query(f"""WITH o AS (SELECT l_orderkey::BIGINT AS doc_id, (l_partkey % 4)::INT AS best, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS i FROM lineitem),
s AS (SELECT *, lag(best, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM o)
SELECT doc_id, string_agg(substr('가나 ', best, 1), '' ORDER BY i) AS text, 75::BIGINT AS percent FROM s WHERE best > 0 AND best <> before GROUP BY doc_id""")
def decoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as a recogniser's steps."""
    scores = F.array(*[F.when(F.col("l_partkey") % 4 == k, 0.75).otherwise(0.08) for k in range(4)])
    steps = _ordered_lines(spark, sf_dir).select(F.col("l_orderkey").cast("long").alias("doc_id"), F.col("i").alias("step"), scores.alias("scores"))
    return geometry.decoded_steps(steps, ["doc_id"], ["가", "나"]).select("doc_id", "text", F.round(F.col("confidence") * 100).cast("long").alias("percent"))


@_query("""SELECT p_partkey::BIGINT AS p_partkey, ['DRM_PROTECTED', 'ENCRYPTED', 'ZIP_BOMB', 'DECOMPRESSION_BOMB', 'NO_SECTIONS', 'PARSE_ERROR', 'CORRUPTED', 'PARSE_ERROR'][(p_partkey % 8 + 1)::INT] AS class FROM part""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ["DRM 암호화", "암호로 보호된 글", "ZIP bomb 의심", "압축 해제 실패", "섹션을 찾을 수 없음", "섹션", "시그니처 불일치", "?"]
    message = F.concat("p_name", F.lit(": "), F.element_at(F.array(*map(F.lit, said)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), text.error_class(message).alias("class"))
