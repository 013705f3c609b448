"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, jaccard_join, language_id, media, mixing, ngram_lm, sentencepiece_codec, staging, substring_dedup, token_store, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Shares of the expected tokens: text of high quality leads, some of low quality stays, and toxic text is left with what uncertain memberships add up to.
DOMAIN_SHARES = {"high": 0.85, "low": 0.1, "toxic": 0.05}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", mixing.quality_domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate and copies for a mix with the shares above."""
    return mixing.mixed(_documents(spark, sf_dir), labelled_domains(spark, sf_dir), DOMAIN_SHARES)


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _media_digest(stored: pd.Series) -> pd.DataFrame:
    rows = []
    for x in stored:
        payload = media.track_bytes(x)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), media.feature(media.probe_bytes(x))))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in a container of its own; payload and features are read back from the container's bytes."""
    staging.bound_batches(spark)
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    stored = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.pack_text("text").alias("media"))
    return stored.select("doc_id", "n_bytes", F.pandas_udf(_media_digest, _DIGEST)("media").alias("d")).select("doc_id", "n_bytes", "d.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


OP3_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a mixed bigram model of the documents that are not held out."""
    return ngram_lm.score_documents(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words and more that a smaller document has."""
    return substring_dedup.remove_duplicates(_documents(spark, sf_dir), texts_too=False)


_WORDS = r"[^\x20\x09-\x0D]+"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
starts AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM starts) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM repeated),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS x, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op6_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document's place and ids in a store that is written and read back. tokenizer: the path of its JSON, on the driver."""
    path = staging.new_path(spark, "tokens")
    definition = Path(tokenizer or public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    token_store.write_store(_documents(spark, sf_dir), path, definition)
    staging.release(spark)
    return token_store.read_store(spark, path)


def encoded_digest(docs: DataFrame, model: str | None = None, ids_too: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, and if asked for ids) of documents in SentencePiece ids and back. model: the path of its file, on the driver."""
    data = Path(model or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return sentencepiece_codec.encoded(docs, data).select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), *["ids"] * ids_too)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encoded_digest(_documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates."""
    return jaccard_join.near_duplicates(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from four fifths of the documents."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language_id.fit(docs.where(~held_out))
    return language_id.detect(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by the rules or else by trust and distrust of its host."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


_LOWERED = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

OP8_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORDS}') AS w FROM documents),
long_ones AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS h FROM long_ones UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT e.a, reach.r FROM reach JOIN e ON e.b = reach.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def _url_sql() -> str:
    """The rules, and the rounds of propagation one after the other."""
    lower = lambda x: f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    link = url_filter._ABSOLUTE.replace("'", "''")
    rounds = ["s0 AS MATERIALIZED (SELECT host, t0 AS t, b0 AS b FROM seeds)"]
    for k in range(url_filter.ROUNDS):
        rounds.append(f"""s{k + 1} AS MATERIALIZED (SELECT host, {1 - url_filter.DAMPING} * t0 + {url_filter.DAMPING} * coalesce(ft, 0) AS t, {1 - url_filter.DAMPING} * b0 + {url_filter.DAMPING} * coalesce(fb, 0) AS b FROM seeds
LEFT JOIN (SELECT dst AS host, sum(t * n / n_out) AS ft FROM e JOIN s{k} ON src = host GROUP BY dst) USING (host) LEFT JOIN (SELECT src AS host, sum(b * n / n_in) AS fb FROM e JOIN s{k} ON dst = host GROUP BY src) USING (host))""")
    return f"""
WITH h AS (SELECT page_id, html, {lower("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS MATERIALIZED (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled FROM h),
c AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM p) WHERE src <> dst GROUP BY ALL),
e AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY src) AS n_out, sum(n) OVER (PARTITION BY dst) AS n_in FROM c),
nodes AS (SELECT host, sum(a) AS a, sum(k) AS k FROM (SELECT host, (ruled = 'allow')::INT AS a, (ruled = 'block')::INT AS k FROM p UNION ALL SELECT unnest([src, dst]), 0, 0 FROM e) GROUP BY host),
seeds AS MATERIALIZED (SELECT host, coalesce(a / nullif(sum(a) OVER (), 0), 0) AS t0, coalesce(k / nullif(sum(k) OVER (), 0), 0) AS b0 FROM nodes),
{", ".join(rounds)}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN t + b > 0 AND b >= {url_filter.THRESHOLD} * (t + b) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN s{url_filter.ROUNDS} USING (host)
"""


def queries() -> dict[str, Query]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_media_columns": op2_media_columns,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_token_store": op6_token_store,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_language_id": op9_language_id,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {
        "op3_exact_dedup": OP3_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op8_jaccard_join": OP8_SQL,
        "op10_url_filter": _url_sql(),
    }
